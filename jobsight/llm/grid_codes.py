"""Vector codes by product quantisation with memoised grid cells.

A vector is cut into consecutive parts; a part's code is the index of the nearest entry of its
position's codebook. Codebooks start as the parts of the vectors with the smallest ids and are
moved by rounds of assigning all parts and averaging. All arithmetic is on integers, so a result
does not depend on the order of rows.

Finding the nearest entry: the space of a part is cut into boxes of side ``step``. A part is
hashed to its box. For a box the entries are kept whose smallest distance to the box is not above
the least of all entries' largest distances; any other entry is farther than that one from every
point of the box. The kept entries of a box are memoised in the task, so parts that fall into a
known box, copies and dense regions above all, skip the test; only kept entries are compared
exactly. Boxes are half a standard deviation wide (``FINENESS``): wider ones are shared by more
parts but dominate nothing.

Every pass reads all rows in one narrow step. A task sends, per entry, its sums and counts, so a
round shuffles one codebook per task and the driver holds the codebooks alone.

Edge cases: vectors that are null, or hold null or non-finite components, or have another length
than most are dropped; a length that the parts do not divide makes the first parts one longer;
integers are held within a bound (2^28 for parts of 16) in which no sum of squares overflows; with
fewer vectors than entries the codebooks are shorter; null ids come last in the choice of the
first entries, equal ids in order of their vectors; repeated rows are coded each; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from jobsight.session import stage

from .text import arrow_schema

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Sides of a box in a standard deviation of the first entries' components.
FINENESS = 2
#: Boxes that a task keeps per part (at most 260 bytes each); beyond it the memo starts anew.
MEMO = 40_000
#: Exact comparisons at a time.
PAIRS = 1 << 17
SALTS = 16


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, v) of the vectors that take part: whole, finite and of the commonest length."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), v.alias("v"))
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("v").isNotNull()).where(good)
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def cuts(width: int, parts: int = PARTS) -> list[slice]:
    """The places of a vector's parts."""
    ends = np.cumsum([0] + [len(p) for p in np.array_split(np.arange(width), parts)]).tolist()
    return [slice(a, b) for a, b in zip(ends, ends[1:])]


def as_integers(v: np.ndarray, scale: int = SCALE, parts: int = PARTS) -> np.ndarray:
    """Components times ``scale``, rounded down."""
    longest = max(1, -(-v.shape[-1] // parts))
    bound = 1 << ((62 - int(np.ceil(np.log2(longest)))) // 2 - 1)
    return np.clip(np.floor(v.astype(np.float64) * scale), -bound, bound).astype(np.int64)


def box_side(entries: np.ndarray, fineness: int = FINENESS) -> int:
    """Side of the boxes of a part, from its first entries."""
    return max(1, int(entries.std() / fineness)) if entries.size else 1


class Grid:
    """The nearest entries of one codebook, by memoised boxes."""

    def __init__(self, entries: np.ndarray, step: int, memo: int = MEMO) -> None:
        self.entries, self.step, self._most = entries, step, memo
        self._memo: dict[bytes, np.ndarray] = {}
        self.boxes = self.compared = 0  # work done, for tests and figures

    def candidates(self, boxes: np.ndarray) -> list[np.ndarray]:
        """Per box the entries that are not dominated across it, ascending."""
        out: list[np.ndarray] = []
        for start in range(0, len(boxes), 512):
            some = boxes[start:start + 512]
            least, most = (np.zeros((len(some), len(self.entries)), np.int64) for _ in range(2))
            for axis in range(boxes.shape[1]):
                places, which = np.unique(some[:, axis], return_inverse=True)
                low, own = (places * self.step)[:, None], self.entries[None, :, axis]
                high = low + (self.step - 1)
                least += (np.maximum(np.maximum(low - own, own - high), 0) ** 2)[which]
                most += (np.maximum(np.abs(own - low), np.abs(high - own)) ** 2)[which]
            kept = least <= most.min(axis=1)[:, None]
            rows, found = np.nonzero(kept)
            out += np.split(found.astype(np.uint16), np.searchsorted(rows, np.arange(1, len(some))))
        return out

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of every point and its squared distance; ties to the lower index."""
        if not points.shape[1]:
            return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
        boxes, which = np.unique(points // self.step, axis=0, return_inverse=True)
        keys = [b.tobytes() for b in boxes]
        new = [i for i, key in enumerate(keys) if key not in self._memo]
        if len(self._memo) + len(new) > self._most:
            self._memo, new = {}, list(range(len(keys)))
        self._memo.update(zip([keys[i] for i in new], self.candidates(boxes[new])))
        self.boxes += len(new)
        lists = [self._memo[key] for key in keys]
        sizes = np.array([len(c) for c in lists])
        order = np.argsort(which.reshape(-1), kind="stable")
        place = which.reshape(-1)[order]
        index, far = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
        ends = np.cumsum(sizes[place])
        start = 0
        while start < len(order):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
            run = place[start:stop]
            asked = np.concatenate([lists[i] for i in run])
            at = np.r_[0, np.cumsum(sizes[run])[:-1]]
            apart = np.repeat(points[order[start:stop]], sizes[run], axis=0) - self.entries[asked]
            apart = np.einsum("ij,ij->i", apart, apart)
            self.compared += len(asked)
            best = np.minimum.reduceat(apart, at)
            ties = np.where(apart == np.repeat(best, sizes[run]), asked.astype(np.int64), len(self.entries))
            index[order[start:stop]], far[order[start:stop]] = np.minimum.reduceat(ties, at), best
            start = stop
        return index, far


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """A column of vectors of one length as integers."""
    return as_integers(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width))


def first_codebooks(rows: DataFrame, entries: int = ENTRIES, parts: int = PARTS) -> list[np.ndarray]:
    """Per part position the parts of the vectors with the smallest ids."""
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    width = len(first[0]["v"]) if first else 0
    whole = as_integers(np.array([r["v"] for r in first], np.float64).reshape(len(first), width), parts=parts)
    return [whole[:, cut] for cut in cuts(whole.shape[1], parts)]


def _assigned_sums(rows: DataFrame, books: list[np.ndarray], steps: list[int]) -> DataFrame:
    """(part, entry, place, total, n): the sum of the parts of every used entry, one row per task and component."""
    width = sum(b.shape[1] for b in books)
    schema = "part int, entry int, place int, total long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b, s) for b, s in zip(books, steps)]
        totals, counts = [np.zeros_like(b) for b in books], [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            points = _matrix(batch.column(0), width)
            for grid, total, count, cut in zip(grids, totals, counts, cuts(width, len(books))):
                index, _ = grid.nearest(points[:, cut])
                np.add.at(total, index, points[:, cut])
                count += np.bincount(index, minlength=len(count))
        for part, (total, count) in enumerate(zip(totals, counts)):
            entry, place = (a.reshape(-1) for a in np.meshgrid(np.flatnonzero(count), np.arange(total.shape[1]), indexing="ij"))
            columns = [np.full(len(entry), part), entry, place, total[entry, place], count[entry]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow)], schema=arrow)

    arrow = arrow_schema(rows, schema)
    return rows.select("v").mapInArrow(run, schema)


def train(rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> tuple[list[np.ndarray], list[int]]:
    """The codebooks, one per part position, and the sides of their boxes."""
    books = first_codebooks(rows, entries, parts)
    steps = [box_side(b) for b in books]
    for _ in range(rounds if books[0].size else 0):
        sums = _assigned_sums(rows, books, steps).groupBy("part", "entry", "place")
        moved = [b.copy() for b in books]
        # One row per component of the codebooks, whatever the size of the table.
        for r in sums.agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect():
            moved[r["part"]][r["entry"], r["place"]] = int(r["total"]) // r["n"]
        books = moved
    return books, steps


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in order of part, entry and place."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], steps: list[int]) -> DataFrame:
    """(vec_id, label, code, error) of every row."""
    width = sum(b.shape[1] for b in books)
    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [Grid(b, s) for b, s in zip(books, steps)]
        for batch in batches:
            points = _matrix(batch.column(2), width)
            found = [g.nearest(points[:, cut]) for g, cut in zip(grids, cuts(width, len(books)))]
            code = ["".join(f"{i:02x}" for i in row) for row in zip(*[index.tolist() for index, _ in found])]
            error = sum(far for _, far in found)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error, pa.int64())], schema=arrow)

    arrow = arrow_schema(rows, schema)
    return rows.select("vec_id", "label", "v").mapInArrow(run, schema)


def vector_codes(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS) -> DataFrame:
    """vec_id, code, error, label_error (errors of equal labels together) and codebooks_sha256.

    A label may hold a third of all rows: totals are combined in each task first, and the rows are
    joined to them under ``SALTS`` keys a label."""
    rows = usable(vectors)
    books, steps = train(rows, entries, rounds, parts)
    coded = stage(encode(rows, books, steps), "vector_codes")
    salt = F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(
        F.col("label").alias("_label"), "label_error", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_told"),
    )
    joined = coded.withColumn("_salt", salt).join(totals, (F.col("_salt") == F.col("_told")) & F.col("label").eqNullSafe(F.col("_label")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def sql(entries: int = ENTRIES, rounds: int = ROUNDS, parts: int = PARTS, scale: int = SCALE) -> str:
    """The same in DuckDB, by comparing every part with every entry of its codebook."""
    steps = [f"""
        rows_ AS MATERIALIZED (
            SELECT row_number() OVER () AS rid, vec_id, label,
                   list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        parts_ AS MATERIALIZED (
            SELECT rid, vec_id, part, v[part * (len(v) // {parts}) + 1 : (part + 1) * (len(v) // {parts})] AS w
            FROM rows_, range({parts}) AS t(part)),
        book0 AS MATERIALIZED (
            SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id NULLS LAST, w) - 1 AS entry, w AS e
            FROM parts_ QUALIFY entry < {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""
        near{i} AS MATERIALIZED (
            SELECT rid, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d
            FROM (SELECT rid, p.part, entry, list_inner_product(w, w) - 2 * list_inner_product(w, e) + list_inner_product(e, e) AS d
                  FROM parts_ p JOIN book{i} b ON p.part = b.part) GROUP BY rid, part)""")
        if i < rounds:
            steps.append(f"""
        mean{i} AS (
            SELECT part, entry, list(m ORDER BY place) AS e FROM (
                SELECT part, entry, place, floor(sum(x) / count(*)) AS m FROM (
                    SELECT p.part, entry, unnest(w) AS x, unnest(range(len(w))) AS place
                    FROM parts_ p JOIN near{i} n ON p.rid = n.rid AND p.part = n.part)
                GROUP BY part, entry, place) GROUP BY part, entry),
        book{i + 1} AS MATERIALIZED (
            SELECT b.part, b.entry, coalesce(m.e, b.e) AS e FROM book{i} b LEFT JOIN mean{i} m ON b.part = m.part AND b.entry = m.entry)""")
    return f"""WITH {",".join(steps)},
        digest_ AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, entry, place)) AS h
                    FROM (SELECT part, entry, unnest(e) AS x, unnest(range(len(e))) AS place FROM book{rounds})),
        coded AS (SELECT rid, string_agg(format('{{:02x}}', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error
                  FROM near{rounds} GROUP BY rid)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
        FROM coded JOIN rows_ USING (rid), digest_"""
