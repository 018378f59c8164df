"""Nearest neighbours by a permutation index.

A bounded sample of vectors are the pivots. Every vector is represented by the order of its
``prefix`` nearest pivots. Rows are dealt into blocks; a block posts its rows in one inverted
file per pivot: the rank that each row gives the pivot. A prefix is half of the pivots, so half
of the rows post in a file, and a file is an array over the rows of the block. A query reads the files of its own
nearest pivots and adds up, per row, the footrule distance: the sum over these pivots of the
difference of the two ranks, where a pivot missing from a prefix has the rank ``prefix``. The
rows that rank first by them are compared exactly, in double precision, and the best of all
blocks are merged. Equal vectors of a block count as one in the shortlist, and all their rows are
candidates with the same score, so a large group of copies takes one place there; different
vectors at the same distance are taken by their smallest vec_id.

The nearness is the inner product, and an order of pivots does not know a row's norm. So rows are
ranked by their norm times the largest cosine that their footrule distance makes likely: for every
query a line of cosine against distance is fitted to ``FITTED`` rows of the block, and one standard
error is added. Rows of one norm are ranked by their footrule distances alone.

Queries go in blocks too, so a task holds one block of rows and one of queries. On vectors
without structure a neighbour's order of pivots is only loosely like the query's, so ``SHARE`` of
every block and ``PER_K`` rows for each wanted neighbour are compared exactly, whatever the size of
the table; recall is measured in the tests.

Edge cases: vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part; a query that is there twice (same id and vector) is asked once, and
queries that share an id are ranked each; of rows repeated with one id each is a candidate of its
own except for its own id; with fewer candidates than ``k`` all are returned; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

K = 20
PIVOTS, PREFIX = 256, 128
SHARE, PER_K = 0.12, 20
LEAST = PER_K * K
#: Rows of a block on which the cosine that a distance stands for is fitted.
FITTED = 512
BLOCK = 8192
SEED = 11


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v as doubles) of the vectors that take part."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    good = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(good & F.exists("v", lambda x: x != 0))


def choose_pivots(rows: DataFrame, pivots: int = PIVOTS) -> np.ndarray:
    """A repeatable sample of at most ``pivots`` distinct vectors of the commonest length."""
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return np.empty((0, 0))
    fitting = rows.where(F.size("v") == sizes[0]["n"])
    firsts = fitting.groupBy(F.xxhash64("v").alias("h")).agg(F.min("vec_id").alias("vec_id"))
    some = firsts.orderBy(F.xxhash64(F.lit(SEED), "vec_id"), "vec_id", "h").limit(pivots).collect()
    places = {(r["vec_id"], r["h"]): i for i, r in enumerate(some)}
    own = fitting.where(F.col("vec_id").isin([r["vec_id"] for r in some])).groupBy("vec_id", F.xxhash64("v").alias("h"))
    found = [r for r in own.agg(F.first("v").alias("v")).collect() if (r["vec_id"], r["h"]) in places]
    return np.array([r["v"] for r in sorted(found, key=lambda r: places[r["vec_id"], r["h"]])])


def distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different vectors in order of their first rows, and for every row the place of its vector."""
    seen: dict[bytes, int] = {}
    groups = np.array([seen.setdefault(r.tobytes(), len(seen)) for r in rows + 0.0])  # -0.0 equals 0.0
    return rows[np.unique(groups, return_index=True)[1]], groups


def ranks(v: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first (largest inner product; ties to the first pivot)."""
    return np.argsort(-(v @ pivots.T), axis=1, kind="stable")[:, :prefix]


def distances(rows: np.ndarray, queries: np.ndarray, pivots: np.ndarray, prefix: int) -> Iterator[np.ndarray]:
    """Per query the footrule distances of all rows of a block, from its inverted files."""
    n, prefix = len(rows), min(prefix, len(pivots))
    # Inverted files: row p lists, for every row of the block, the rank that it posts for pivot p.
    files = np.full((len(pivots), n), prefix, np.int16)
    files[ranks(rows, pivots, prefix), np.arange(n)[:, None]] = np.arange(prefix, dtype=np.int16)
    own = np.arange(prefix, dtype=np.int16)
    for mine in ranks(queries, pivots, prefix):
        far = np.zeros(n, np.int32)
        for start in range(0, prefix, 16):  # 16 files at a time stay in the processor's cache
            far += np.abs(files[mine[start:start + 16]] - own[start:start + 16, None]).sum(axis=0, dtype=np.int32)
        yield far


def first_rows(key: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` rows with the smallest keys, ties to the first row."""
    last = np.partition(key, most - 1)[most - 1]
    below = np.flatnonzero(key < last)
    return np.concatenate([below, np.flatnonzero(key == last)[:most - len(below)]])


def shortlists(rows: np.ndarray, queries: np.ndarray, pivots: np.ndarray, prefix: int, most: int) -> list[np.ndarray]:
    """Per query the ``most`` rows of a block with the smallest footrule distance, ties to the first row."""
    if most >= len(rows):
        return [np.arange(len(rows))] * len(queries)
    return [first_rows(far, most) for far in distances(rows, queries, pivots, prefix)]


def product_shortlists(rows: np.ndarray, queries: np.ndarray, pivots: np.ndarray, prefix: int, most: int) -> list[np.ndarray]:
    """Per query the ``most`` rows of a block whose norm and footrule distance promise the largest inner product."""
    if most >= len(rows):
        return [np.arange(len(rows))] * len(queries)
    norms = np.linalg.norm(rows, axis=1)
    fitted = np.unique(np.linspace(0, len(rows) - 1, FITTED).astype(int))
    directions, out = rows[fitted] / norms[fitted, None], []
    for q, far in zip(queries, distances(rows, queries, pivots / np.linalg.norm(pivots, axis=1)[:, None], prefix)):
        cosine, x = directions @ (q / np.linalg.norm(q)), far[fitted].astype(np.float64)
        spread = x - x.mean()
        slope = (spread @ cosine) / max(spread @ spread, 1e-300)
        if slope >= 0:  # distances that say nothing, as of one row
            slope, cosine = -1.0, -spread
        error = np.std(cosine - slope * spread)
        out.append(first_rows(-norms * (cosine.mean() + slope * (far - x.mean()) + error), most))
    return out


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, pivots: int = PIVOTS, prefix: int = PREFIX,
            share: float = SHARE, least: int | None = None, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows by inner product.

    Both arguments are (vec_id, v) as ``usable`` gives them. ``share`` of a block and ``least``
    rows more (``PER_K`` for each neighbour) are compared exactly; a share of 1 gives the exact result.
    """
    least = PER_K * k if least is None else least
    centres = choose_pivots(vectors, pivots)
    width = centres.shape[1] if len(centres) else 0
    fits = F.size("v") == width
    n_rows, n_queries = vectors.where(fits).count(), queries.where(fits).count()
    r_blocks, q_blocks = max(1, -(-n_rows // block)), max(1, -(-n_queries // block))
    deal = lambda blocks, seed: F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    data = vectors.where(fits).select("vec_id", "v", deal(r_blocks, 1).alias("rb")).select("*", every(q_blocks).alias("qb"))
    # A query that is there twice is asked once; queries that share an id are told apart by ``q``.
    asked = queries.where(fits).dropDuplicates(["vec_id", "v"]).select("vec_id", "v", F.xxhash64("v").alias("q"), deal(q_blocks, 2).alias("qb"))
    asked = asked.select("*", every(r_blocks).alias("rb"))

    def search(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(asked):
            return pd.DataFrame({"query_id": [], "q": [], "vec_id": [], "score": []})
        rows, asked = rows.sort_values("vec_id"), asked.sort_values("vec_id")
        a, groups = distinct(np.stack(rows["v"].to_numpy()))
        queries = np.stack(asked["v"].to_numpy())
        ids, found = rows["vec_id"].to_numpy(), []
        most = min(len(a), int(np.ceil(share * len(ids))) + least)
        for own, q, vector, near in zip(asked["vec_id"].tolist(), asked["q"].tolist(), queries, product_shortlists(a, queries, centres, prefix, most)):
            scores = np.full(len(a), -np.inf)
            scores[near] = (a[near] * vector).sum(axis=1)  # the same for equal vectors of all blocks
            close = np.flatnonzero((scores[groups] > -np.inf) & (ids != own))
            score = scores[groups[close]]
            best = np.lexsort((ids[close], -score))[:k]
            found.append(pd.DataFrame({"query_id": own, "q": q, "vec_id": ids[close][best], "score": score[best]}))
        return pd.concat(found)

    found = data.groupBy("rb", "qb").cogroup(asked.groupBy("rb", "qb")).applyInPandas(search, "query_id long, q long, vec_id long, score double")
    place = F.row_number().over(W.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
