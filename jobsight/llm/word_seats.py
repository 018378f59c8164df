"""The lowest level of the Pitman-Yor model: one restaurant for every word that comes before.

    word before  ->  its class  ->  its coarse class  ->  root  ->  uniform over words

Every word of the texts is a context of its own; classes (``hpylm.context_of``) are only its
parents. A cell (word, word before) with c customers has t tables; all four levels are seated by
Gibbs as described in ``hpylm``: a sweep draws the tables of every cell, then those of every
(word, class), (word, coarse class) and word, and z of all restaurants.

**Ids.** A word has the id ``group << 30 | class << 20 | rank``: its group is a hash of the word
(one per ``GROUP_BYTES`` of text, so groups keep their size as texts grow), its rank is that among
the words of group and class. The start of a text is the context 0. Draws are hashes of these ids.

**Where things lie.** Cells lie with the group of their word, where all levels but the lowest are
complete. The totals of a context lie with the group of the context. In a sweep the groups of words
send, for every context of theirs with a cell of two customers or more, the sum of its tables to the
context's group, which sends back the sum over all groups; z follows from it by a hash. A cell of
one customer always has one table, so it takes no part in this exchange but in the totals.

**Files.** Texts are split once; tokens of a run, cells of a group, the lists of contexts and
the tables after a sweep are files in the folder of the run, written under temporary names and renamed,
so a task that runs again writes the same. Only sums, and the probabilities of the cells of a run,
pass through shuffles, packed to few bytes each.
"""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from jobsight.session import scratch_path, stage

from . import hpylm
from .text import arrow_schema, held_out, pieces, whole_texts

GROUP_BYTES, LEAST_GROUPS = 16_000_000, 8
CLASS_BITS, RANK_BITS = 10, 20
GROUP = CLASS_BITS + RANK_BITS
SIZES = [hpylm.COARSE * hpylm.FINE, hpylm.COARSE, 1]  # restaurants of the upper levels


# ---- packed numbers and files -------------------------------------------------------------

def squeeze(x: np.ndarray) -> bytes:
    """Whole numbers from 0 on, as compressed planes of their bytes."""
    x = np.ascontiguousarray(x, "<u8")
    wide = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 0
    planes = x.view("u1").reshape(-1, 8)[:, :wide].T.tobytes()
    return struct.pack("<qB", len(x), wide) + (pa.compress(planes, "zstd", asbytes=True) if len(x) else b"")


def spread(blob: bytes) -> np.ndarray:
    n, wide = struct.unpack_from("<qB", blob)
    out = np.zeros((n, 8), "u1")
    if n:
        raw = pa.decompress(memoryview(blob)[9:], n * wide, "zstd")
        out[:, :wide] = np.frombuffer(raw, "u1").reshape(wide, n).T
    return out.view("<i8").ravel()


def rising(x: np.ndarray) -> bytes:
    """As ``squeeze``, for sorted numbers."""
    return squeeze(np.diff(x, prepend=0))


def risen(blob: bytes) -> np.ndarray:
    return np.cumsum(spread(blob))


def _write(folder: str, name: str, blobs: list[bytes]) -> None:
    fs, root = pafs.FileSystem.from_uri(folder)
    fs.create_dir(root)
    tried = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(tried) as out:
        out.write(struct.pack(f"<q{len(blobs)}q", len(blobs), *map(len, blobs)))
        for blob in blobs:
            out.write(blob)
    fs.move(tried, f"{root}/{name}")


def _read(folder: str, name: str) -> list[bytes]:
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/{name}") as file:
        n, = struct.unpack("<q", file.read(8))
        return [file.read(size) for size in struct.unpack(f"<{n}q", file.read(8 * n))]


def _by(df: DataFrame, key: str, order: str, work, schema: str, place: tuple[int, Column] | None = None) -> DataFrame:
    """``work(key, rows)`` for all rows of a key, ordered; it yields rows as tuples.

    The rows are few and short for the work they stand for, so ``place``, how many tasks there are and
    which is a key's, keeps tasks from being put together by their size."""
    arrow = arrow_schema(df, schema)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(batch.num_rows):  # one at a time: a row holds long columns
                yield batch.slice(at, 1).to_pylist()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for value, rows in groupby(rows_of(batches), lambda r: r[key]):
            for row in work(value, rows):
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, row))], schema=arrow)

    dealt = df.repartitionById(*place) if place else df.repartition(key)
    return dealt.sortWithinPartitions(key, order).mapInArrow(run, schema)


# ---- tokens and words ---------------------------------------------------------------------

class _Numbers(dict):
    """Words to numbers, in order of their first use; the end token has the number 0."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


WORDS = "run long, part int, words binary, counts binary"


def split_texts(docs: DataFrame, folder: str, groups: int) -> DataFrame:
    """Write the tokens of every run; per run and group its words and how often they are learned from."""
    limit, limit_docs = hpylm.RUN, hpylm.RUN_DOCS
    arrow = arrow_schema(docs, WORDS)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        numbers, tokens, ids, learn, n = _Numbers({hpylm.END: 0}), [], [], [], 0

        def run() -> pa.RecordBatch:
            size, word = np.array([len(t) for t in tokens]), np.concatenate(tokens)
            counts = np.bincount(word[np.repeat(learn, size)], minlength=len(numbers))
            words = list(numbers)
            part = np.fromiter((zlib.crc32(w) % groups for w in words), np.int64, len(words))
            _write(f"{folder}/tokens", str(number), [
                squeeze(word), squeeze(size), np.array([i or 0 for i in ids], "<i8").tobytes(),
                np.array([i is None for i in ids], "u1").tobytes(), np.array(learn, "u1").tobytes(), squeeze(part),
            ])
            order = np.argsort(part, kind="stable")
            starts = hpylm._groups(part[order])
            return pa.RecordBatch.from_pylist([
                {"run": number, "part": int(part[some[0]]), "words": b" ".join([words[k] for k in some.tolist()]), "counts": squeeze(counts[some])}
                for some in np.split(order, starts[1:])
            ], schema=arrow)

        for batch in batches:
            for doc_id, text, held in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                get = numbers.__getitem__
                own = [np.fromiter(map(get, p.split()), np.int32) for p in pieces(text.as_py().lower())]
                tokens.append(np.concatenate([*own, np.zeros(1, np.int32)]))
                ids.append(doc_id)
                learn.append(not held)
                n += len(tokens[-1])
                if n >= limit or len(ids) >= limit_docs:
                    yield run()
                    number += 1
                    numbers, tokens, ids, learn, n = _Numbers({hpylm.END: 0}), [], [], [], 0
        if ids:
            yield run()

    return whole_texts(docs, held_out(F.col("doc_id"), hpylm.MODULUS).alias("held")).mapInArrow(work, WORDS)


def number_words(rows: DataFrame, groups: int) -> DataFrame:
    """Per run and group the ids of its words; the last row of a group has its known words and their tokens."""

    def work(part: int, rows: Iterator[dict]) -> Iterator[tuple]:
        numbers, listed, counts = _Numbers(), [], np.zeros(0, np.int64)
        for r in rows:
            own = np.fromiter(map(numbers.__getitem__, r["words"].split(b" ")), np.int64)
            counts = np.concatenate([counts, np.zeros(len(numbers) - len(counts), np.int64)])
            counts[own] += spread(r["counts"])
            listed.append((r["run"], own))
        words = list(numbers)
        kind = np.fromiter(map(hpylm.context_of, words), np.int64, len(words))
        order = np.array(sorted(range(len(words)), key=lambda k: (kind[k], words[k])), np.int64)
        starts = hpylm._groups(kind[order])
        rank = np.arange(len(words)) - np.repeat(starts, np.diff(np.append(starts, len(words))))
        if rank.max() >> RANK_BITS:
            raise ValueError("Too many words of one class in a group.")
        ids = np.empty(len(words), np.int64)
        ids[order] = part << GROUP | kind[order] << RANK_BITS | rank
        for run, own in listed:
            yield run, part, squeeze(ids[own]), None, None
        yield None, part, None, int(np.count_nonzero(counts)), int(counts.sum())

    return _by(rows, "part", "run", work, "run long, part int, ids binary, types long, tokens long", (groups, F.col("part")))


def _cells_of(folder: str, run: int, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(distinct cells of a run as rank of word << 32 | 1 + rank of the word before, 0 at a start; the
    cell of each token; the columns of its file), with words ranked by their ids."""
    blobs = _read(f"{folder}/tokens", str(run))
    word, size = rank[spread(blobs[0])], spread(blobs[1])
    before = np.empty_like(word)
    before[1:] = word[:-1] + 1
    before[np.cumsum(size) - size] = 0
    cells, at = np.unique(word << 32 | before, return_inverse=True)
    return cells, at, blobs


CELLS = "part int, run long, words binary, befores binary, counts binary"


def count_cells(codes: DataFrame, folder: str, place: tuple[int, Column]) -> DataFrame:
    """Per group and run: its cells in order, and how often they are learned from."""

    def work(run: int, rows: Iterator[dict]) -> Iterator[tuple]:
        found = np.concatenate([spread(r["ids"]) for r in rows])
        part = spread(_read(f"{folder}/tokens", str(run))[5])
        ids = np.empty(len(part), np.int64)
        ids[np.argsort(part, kind="stable")] = found
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        _write(f"{folder}/ranks", str(run), [squeeze(rank)])
        cells, at, blobs = _cells_of(folder, run, rank)
        learn = np.repeat(np.frombuffer(blobs[4], "u1"), spread(blobs[1])).astype(bool)
        counts = np.bincount(at[learn], minlength=len(cells))
        ids = ids[order]
        word, before = ids[cells >> 32], np.append(0, ids)[cells & 0xFFFFFFFF]
        starts = hpylm._groups(word >> GROUP)
        for a, b in zip(starts, np.append(starts[1:], len(word))):
            yield int(word[a] >> GROUP), run, rising(word[a:b] & ((1 << GROUP) - 1)), squeeze(before[a:b]), squeeze(counts[a:b])

    return _by(codes, "run", "part", work, CELLS, place)


# ---- seating ------------------------------------------------------------------------------

def gamma(shape: np.ndarray, key: np.ndarray, seed: int) -> np.ndarray:
    """Gamma variables of shapes above 1 that depend on 64-bit keys and a seed only (Marsaglia and Tsang)."""
    out, d = np.empty(len(shape)), shape - 1 / 3
    open_ = np.arange(len(shape))
    while len(open_):
        u, v, w = (hpylm._random(key[open_], seed + k) for k in range(3))
        x = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        g = d[open_]
        cube = (1 + x / np.sqrt(9 * g)) ** 3
        fits = cube > 0
        fits[fits] = np.log(w[fits]) < 0.5 * x[fits] ** 2 + g[fits] * (1 - cube[fits] + np.log(cube[fits]))
        out[open_[fits]] = g[fits] * cube[fits]
        open_, seed = open_[~fits], seed + 3
    return out


class Group:
    """Cells of the words of a group, and the tables of all levels."""

    def __init__(self, blobs: list[bytes]) -> None:
        self.words, self.befores = risen(blobs[0]), risen(blobs[1])
        word, self.before = np.divmod(risen(blobs[2]), len(self.befores))
        counts = spread(blobs[3])
        self.runs, self.run_sizes, self._places = np.frombuffer(blobs[4], "<i8"), spread(blobs[5]), blobs[6]
        context = (self.befores >> RANK_BITS & ((1 << CLASS_BITS) - 1))[self.before]
        # Cells are sorted by word and the word before, whose id begins with its group: not by class.
        key, up = np.unique(word * SIZES[0] + context, return_inverse=True)
        coarse_key, up_coarse = np.unique(key // hpylm.FINE, return_inverse=True)
        #: Restaurant of a cell and its cell of the level above, by level; classes, coarse classes, root.
        self.at = [key % SIZES[0], coarse_key % hpylm.COARSE, np.zeros(len(self.words), np.int64)]
        self.up = [up, up_coarse, coarse_key // hpylm.COARSE]
        self.word, self.n = word, np.bincount(word, counts, len(self.words))
        self.c = [counts.astype(np.float64), None, None, None]
        self.many = np.flatnonzero(counts > 1)
        #: Contexts, by their place, that a drawn cell has, and how many tables theirs have at first.
        self.drawn = np.bincount(self.before[self.many], minlength=len(self.befores))
        self.t = [np.minimum(self.c[0], 1)] + [None] * 3
        for level in range(3):
            self._climb(level)
            self.t[level + 1] = np.minimum(self.c[level + 1], 1)
        spreads = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], np.uint64)
        mixed = lambda w, c: self.words.astype(np.uint64)[w] * spreads[0] + c.astype(np.uint64) * spreads[1]
        self.keys = [
            mixed(word[self.many], self.befores[self.before[self.many]]), mixed(key // SIZES[0], 1 + self.at[0]),
            mixed(self.up[2], 1 + SIZES[0] + self.at[1]), mixed(np.arange(len(self.words)), np.zeros(len(self.words))),
        ]

    def _climb(self, level: int) -> None:
        size = len(self.at[level])
        self.c[level + 1] = np.bincount(self.up[level], self.t[level], size)

    def places(self) -> np.ndarray:
        """Cells of the runs, one run after the other, as places in all cells."""
        return risen(self._places) % len(self.word)

    def state(self) -> list[bytes]:
        return [squeeze(self.t[0][self.many]), *[squeeze(t) for t in self.t[1:]]]

    def restore(self, blobs: list[bytes]) -> None:
        self.t[0][self.many] = spread(blobs[0])
        for level in range(3):
            self._climb(level)
            self.t[level + 1] = spread(blobs[level + 1]).astype(np.float64)

    def parents(self, g: hpylm.Totals, discount: float) -> list[np.ndarray]:
        """Predictive probabilities of every class cell, coarse cell and word."""
        own = lambda level: (self.c[level + 1] - g.discount[level] * self.t[level + 1]) / (hpylm.STRENGTH + g.customers[level][self.at[level]])
        root = own(2) + g.back_off(2)[0] * g.uniform
        coarse = own(1) + g.back_off(1)[self.at[1]] * root[self.up[2]]
        return [own(0) + g.back_off(0)[self.at[0]] * coarse[self.up[1]], coarse, root]

    def sweep(self, g: hpylm.Totals, discount: float, tables: np.ndarray, number: int) -> None:
        """Draw all tables again; ``tables``: those of the contexts of drawn cells, by place."""
        up = self.parents(g, discount)
        some = np.flatnonzero(self.drawn)
        z = np.zeros(len(self.befores))
        ids = self.befores[some].astype(np.uint64) + np.uint64(1)
        z[some] = gamma(hpylm.STRENGTH / discount + tables, ids, 1_000_000 * (number + 1))
        many = self.many
        self.t[0][many] = hpylm.draw_tables(
            self.c[0][many], discount * z[self.before[many]] * up[0][self.up[0][many]], hpylm._random(self.keys[0], 4 * number), discount)
        for level in range(3):
            self._climb(level)
            c, d = self.c[level + 1], g.discount[level]
            self.t[level + 1] = np.minimum(c, 1)
            draw = np.flatnonzero(c > 1)
            parent = up[level + 1][self.up[level + 1][draw]] if level < 2 else np.full(len(draw), g.uniform)
            self.t[level + 1][draw] = hpylm.draw_tables(
                c[draw], d * g.z[level][self.at[level][draw]] * parent, hpylm._random(self.keys[level + 1][draw], 4 * number + level + 1), d)

    def totals(self) -> bytes:
        """Tables and customers of the upper levels, and cells with one and two customers of all levels."""
        sums = [np.bincount(at, x, size) for x in (self.t, self.c) for at, x, size in zip(self.at, x[1:], SIZES)]
        few = np.array([np.count_nonzero(c == k) for c in self.c for k in (1, 2)], float)
        return np.concatenate([*sums, few]).astype("<f8").tobytes()

    def sums(self) -> np.ndarray:
        """Tables of the drawn cells of every context that has any."""
        return np.bincount(self.before[self.many], self.t[0][self.many], len(self.befores))[self.drawn > 0]

    def split(self, places: np.ndarray) -> Iterator[tuple[int, slice]]:
        """(group, part) of some contexts in order."""
        group = self.befores[places] >> GROUP
        starts = hpylm._groups(group)
        for a, b in zip(starts.tolist(), np.append(starts[1:], len(group)).tolist()):
            yield int(group[a]), slice(a, b)


LISTS = "at int, part int, befores binary, counts binary, alone binary, drawn binary, totals binary"
SUMS = "at int, part int, tables binary, totals binary"
TABLES = "part int, at int, tables binary"


def gather(cells: DataFrame, folder: str, groups: int) -> DataFrame:
    """Write the cells of every group; per group of contexts (``at``) its contexts, their customers, and
    their tables in cells that are alone and in cells that are drawn."""

    def work(part: int, rows: Iterator[dict]) -> Iterator[tuple]:
        rows = [(r["run"], risen(r["words"]), spread(r["befores"]), spread(r["counts"])) for r in rows]
        words, word = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        befores, before = np.unique(np.concatenate([r[2] for r in rows]), return_inverse=True)
        cells, place = np.unique(word << 32 | before, return_inverse=True)
        counts = np.bincount(place, np.concatenate([r[3] for r in rows]), len(cells))
        sizes = np.array([len(r[1]) for r in rows])
        del word, before
        blobs = [
            rising(words | part << GROUP), rising(befores), rising((cells >> 32) * len(befores) + (cells & 0xFFFFFFFF)), squeeze(counts),
            np.array([r[0] for r in rows], "<i8").tobytes(), squeeze(sizes), rising(place + np.repeat(np.arange(len(rows)), sizes) * len(cells)),
        ]
        _write(f"{folder}/cells", str(part), blobs)
        group = Group(blobs)
        customers = np.bincount(group.before, group.c[0], len(befores))
        alone = np.bincount(group.before, group.c[0] == 1, len(befores))
        for at, some in group.split(np.arange(len(befores))):
            yield at, part, rising(befores[some]), squeeze(customers[some]), squeeze(alone[some]), squeeze(group.drawn[some]), None
        yield -1, part, None, None, None, None, group.totals()

    return _by(cells, "part", "run", work, LISTS, (groups, F.col("part")))


def meet(lists: DataFrame, folder: str, groups: int) -> DataFrame:
    """Write the lists of every group of contexts, and send back the tables of contexts of drawn cells."""

    def work(at: int, rows: Iterator[dict]) -> Iterator[tuple]:
        rows = [(r["part"], risen(r["befores"]), *[spread(r[k]) for k in ("counts", "alone", "drawn")]) for r in rows]
        ids, place = np.unique(np.concatenate([r[1] for r in rows]), return_inverse=True)
        customers, alone, drawn = (np.bincount(place, np.concatenate([r[k] for r in rows]), len(ids)).astype(np.int64) for k in (2, 3, 4))
        sizes, some = np.array([len(r[1]) for r in rows]), np.concatenate([r[4] for r in rows]) > 0
        _write(f"{folder}/contexts", str(at), [
            np.array([r[0] for r in rows], "<i8").tobytes(), squeeze(sizes), rising(place + np.repeat(np.arange(len(rows)), sizes) * len(ids)), np.packbits(some).tobytes(), squeeze(customers), squeeze(alone),
        ])
        yield from _sent(at, [r[0] for r in rows], sizes, place, some, alone + drawn)

    return _by(lists.where("at >= 0"), "at", "part", work, TABLES, (groups, F.col("at")))


def _sent(at: int, parts: list[int], sizes: np.ndarray, place: np.ndarray, some: np.ndarray, tables: np.ndarray) -> Iterator[tuple]:
    ends = np.append(0, np.cumsum(sizes))
    for part, a, b in zip(parts, ends, ends[1:]):
        if some[a:b].any():
            yield part, at, squeeze(tables[place[a:b][some[a:b]]])


def _lists(folder: str, at: int) -> tuple:
    """(parts, sizes, places, which are drawn, customers, tables of cells alone) of a group of contexts."""
    blobs = _read(f"{folder}/contexts", str(at))
    customers, place = spread(blobs[4]), risen(blobs[2])
    place %= max(1, len(customers))
    some = np.unpackbits(np.frombuffer(blobs[3], "u1"), count=len(place)).astype(bool)
    return np.frombuffer(blobs[0], "<i8").tolist(), spread(blobs[1]), place, some, customers, spread(blobs[5])


def add_up(sums: DataFrame, folder: str, groups: int, number: int) -> DataFrame:
    """As ``meet``, after a sweep; keeps the tables of all contexts."""

    def work(at: int, rows: Iterator[dict]) -> Iterator[tuple]:
        parts, sizes, place, some, _, alone = _lists(folder, at)
        drawn = np.concatenate([spread(r["tables"]) for r in rows])  # of the same parts in the same order
        tables = alone + np.bincount(place[some], drawn, len(alone)).astype(np.int64)
        _write(f"{folder}/tables{number}", str(at), [squeeze(tables)])
        yield from _sent(at, parts, sizes, place, some, tables)

    return _by(sums.where("at >= 0"), "at", "part", work, TABLES, (groups, F.col("at")))


def _every(tables: DataFrame, groups: int) -> DataFrame:
    """``tables`` and one row more for each group, so that one without such rows is worked on, too."""
    more = tables.sparkSession.range(groups).select(F.col("id").cast("int").alias("part"), F.lit(-1).alias("at"))
    return tables.unionByName(more, allowMissingColumns=True)


def _exists(folder: str, part: int) -> bool:
    fs, root = pafs.FileSystem.from_uri(folder)
    return fs.get_file_info(f"{root}/cells/{part}").type == pafs.FileType.File


def _restored(folder: str, part: int, number: int) -> Group:
    group = Group(_read(f"{folder}/cells", str(part)))
    if number >= 0:
        group.restore(_read(f"{folder}/state{number}", str(part)))
    return group


def draw(tables: DataFrame, folder: str, groups: int, g: hpylm.Totals, discount: float, number: int) -> DataFrame:
    """One sweep: write the tables of every group, and give their sums by context."""

    def work(part: int, rows: Iterator[dict]) -> Iterator[tuple]:
        if not _exists(folder, part):
            return
        group = _restored(folder, part, number - 1)
        found = [spread(r["tables"]) for r in rows if r["at"] >= 0]
        group.sweep(g, discount, np.concatenate([np.zeros(0), *found]), number)
        _write(f"{folder}/state{number}", str(part), group.state())
        sums = group.sums()
        for at, some in group.split(np.flatnonzero(group.drawn)):
            yield at, part, squeeze(sums[some]), None
        yield -1, part, None, group.totals()

    return _by(_every(tables, groups), "part", "at", work, SUMS, (groups, F.col("part")))


def _totals(rows: DataFrame, past: list[hpylm.Totals], uniform: float) -> tuple[hpylm.Totals, float]:
    """Totals of the upper levels with new z, and the discount of the lowest."""
    wide = 2 * sum(SIZES)

    def work(_, rows: Iterator[dict]) -> Iterator[tuple]:
        yield (sum(np.frombuffer(r["totals"], "<f8") for r in rows).tobytes(),)

    found = _by(rows.where("at = -1").withColumn("all", F.lit(0)), "all", "part", work, "totals binary").first()
    sums = np.frombuffer(found.totals, "<f8") if found else np.zeros(wide + 8)
    *split, few = np.split(sums, np.cumsum(SIZES * 2))
    discounts = [float(np.clip((one + 0.5) / (one + 2 * two + 1), 0.05, 0.95)) for one, two in few.reshape(4, 2)]
    tables, customers, discount = split[:3], split[3:], past[0].discount if past else discounts[1:]
    rng = np.random.default_rng([hpylm.SEED, len(past)])
    z = [rng.gamma(hpylm.STRENGTH / d + t) for d, t in zip(discount, tables)]
    return hpylm.Totals(customers, tables, z, discount, uniform), discounts[0]


# ---- probabilities and scores -------------------------------------------------------------

def tell(spark, folder: str, groups: int, kept: list[int]) -> DataFrame:
    """Customers and tables of all contexts, to every group of words that has them."""
    schema = "part int, at int, customers binary, tables array<binary>"
    rows = spark.range(0, groups, 1, groups).select(F.col("id").cast("int").alias("at"))
    arrow = arrow_schema(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in batch.column(0).to_pylist():
                fs, root = pafs.FileSystem.from_uri(folder)
                if fs.get_file_info(f"{root}/contexts/{at}").type != pafs.FileType.File:
                    continue
                parts, sizes, place, some, customers, alone = _lists(folder, at)
                # No cell of a group of contexts is ever drawn: its tables stay as they are.
                tables = [spread(_read(f"{folder}/tables{k}", str(at))[0]) if some.any() else alone for k in kept]
                ends = np.append(0, np.cumsum(sizes))
                for part, a, b in zip(parts, ends, ends[1:]):
                    own = place[a:b]
                    yield pa.RecordBatch.from_pylist([{
                        "part": part, "at": at, "customers": squeeze(customers[own]), "tables": [squeeze(t[own]) for t in tables],
                    }], schema=arrow)

    return rows.mapInArrow(run, schema)


def probabilities(told: DataFrame, folder: str, groups: int, past: list[hpylm.Totals], discount: float, kept: list[int]) -> DataFrame:
    """Per run and group: the probabilities of its cells, and the counts of its words."""

    def work(part: int, rows: Iterator[dict]) -> Iterator[tuple]:
        group = _restored(folder, part, -1)
        rows = [(spread(r["customers"]), [spread(t) for t in r["tables"]]) for r in rows]
        customers = hpylm.STRENGTH + np.concatenate([r[0] for r in rows])[group.before]
        p = np.zeros(len(group.before))
        for k, number in enumerate(kept):
            group.restore(_read(f"{folder}/state{number}", str(part)))
            tables = np.concatenate([r[1][k] for r in rows])[group.before]
            parent = group.parents(past[number + 1], discount)[0][group.up[0]]
            p += (group.c[0] - discount * group.t[0] + (hpylm.STRENGTH + discount * tables) * parent) / customers
        p, places = (p / len(kept)).astype("<f4"), group.places()
        ends = np.append(0, np.cumsum(group.run_sizes))
        for run, a, b in zip(group.runs.tolist(), ends, ends[1:]):
            own = group.word[places[a:b]]
            yield run, part, p[places[a:b]].tobytes(), squeeze(group.n[own[hpylm._groups(own)]])

    return _by(told, "part", "at", work, "run long, part int, p binary, n binary", (groups, F.col("part")))


def add_scores(found: DataFrame, folder: str, place: tuple[int, Column], tokens: int, types: int) -> DataFrame:
    """One row per row of the texts: doc_id, n_tokens, n_known, base_score and score (log10)."""
    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double"
    whole = tokens + 0.5 * (types + 1)
    arrow = arrow_schema(found, schema)

    def run_scores(run: int, rows: list[dict]) -> pa.RecordBatch:
        p = np.concatenate([np.frombuffer(r["p"], "<f4") for r in rows]).astype(np.float64)
        n = np.concatenate([spread(r["n"]) for r in rows])
        rank = spread(_read(f"{folder}/ranks", str(run))[0])
        cells, at, blobs = _cells_of(folder, run, rank)
        size = spread(blobs[1])
        doc = np.repeat(np.arange(len(size)), size)
        n = n[cells[at] >> 32]  # every word of a run is in a cell, so its rank is its place
        total = lambda x: np.bincount(doc, x, len(size))
        null = np.frombuffer(blobs[3], "u1").astype(bool)
        return pa.RecordBatch.from_arrays([
            pa.array(np.frombuffer(blobs[2], "<i8"), mask=null), pa.array(size), pa.array(total(n > 0).astype(np.int64)),
            pa.array(total(np.log10((n + 0.5) / whole))), pa.array(total(np.log10(p)[at])),
        ], schema=arrow)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (batch.slice(at, 1).to_pylist()[0] for batch in batches for at in range(batch.num_rows))
        for run, own in groupby(rows, lambda r: r["run"]):
            yield run_scores(run, list(own))

    return found.repartitionById(*place).sortWithinPartitions("run", "part").mapInArrow(work, schema)


def score_all(docs: DataFrame, burn: int, samples: int) -> tuple[DataFrame, int]:
    """(scores of all rows, tokens learned from), learned from the rows that are not held out."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "hpy_files")
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(LEAST_GROUPS, math.ceil(size / GROUP_BYTES))
    codes = stage(number_words(split_texts(docs, folder, groups), groups), "hpy_words")
    in_task, task = F.col("run").bitwiseAND(0xFFFFFFFF), F.shiftright("run", 32)
    types, tokens, runs, tasks = (n or 0 for n in codes.agg(F.sum("types"), F.sum("tokens"), F.max(in_task) + 1, F.max(task) + 1).first())
    place = max(1, runs * tasks), (task * runs + in_task).cast("int")
    uniform = 1.0 / (types + 1)
    lists = stage(gather(count_cells(codes.where("run is not null"), folder, place), folder, groups), "hpy_lists")
    first, discount = _totals(lists, [], uniform)
    past, tables = [first], stage(meet(lists, folder, groups), "hpy_tables")
    for number in range(burn + samples):
        sums = stage(draw(tables, folder, groups, past[-1], discount, number), "hpy_sums")
        past.append(_totals(sums, past, uniform)[0])
        tables = stage(add_up(sums, folder, groups, number), "hpy_tables")
    kept = list(range(burn, burn + samples))
    found = probabilities(tell(spark, folder, groups, kept), folder, groups, past, discount, kept)
    return add_scores(found, folder, place, tokens, types), tokens
