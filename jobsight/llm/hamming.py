"""Links between fingerprints within a Hamming distance, by vantage-point trees.

Distributed part. ``pieces`` blocks of bits and ``radius`` differing bits: any linked pair
agrees in at least ``pieces - radius`` blocks, so with 6 blocks and radius 4 in at least 2.
For every choice of 2 blocks the fingerprints are dealt into shards at the projected distance
0, where the triangle bound is tight: a ball of radius 0 never overlaps a second shard.
(On whole fingerprints the bound is loose: distances of unlike texts lie around 32 +- 4, so
about 68 % of all balls of radius 4 cross a median split, and a tree of splits visits
N^0.75 nodes for each query.)

In a shard, fingerprints are linked by a vantage-point tree on the whole distance: points are
split at the median distance from a vantage point, and only those within the radius of the
split are asked on both sides. Shards hold distinct fingerprints only; the tree returns a
spanning forest, never all pairs of a dense group.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

RADIUS = 4
BITS = 64
#: Up to so many points are compared directly.
LEAF = 64
_BLOCK = 1 << 20


class Forest:
    """Union-find over the points of one shard, with the edges that joined two trees."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)
        self.edges: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        root = self.root
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    def link(self, a: int, b: int) -> None:
        x, y = self.find(a), self.find(b)
        if x != y:
            self.root[max(x, y)] = min(x, y)
            self.edges.append((a, b))

    def labels(self, points: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[self.root]
            if (up == self.root).all():
                return self.root[points]
            self.root = up


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _compare(p: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    """Link the points a and b (indexes) directly, in blocks."""
    step = max(1, _BLOCK // max(1, len(b)))
    for start in range(0, len(a), step):
        rows = a[start:start + step]
        near = _distance(p[rows][:, None], p[b][None, :]) <= radius
        while True:
            apart = near & (forest.labels(rows)[:, None] != forest.labels(b)[None, :])
            hit = np.flatnonzero(apart.any(axis=1))
            if not len(hit):
                break
            for i, j in zip(rows[hit].tolist(), b[apart[hit].argmax(axis=1)].tolist()):
                forest.link(i, j)


def _across(p: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, forest: Forest) -> None:
    """Links between two sets: both are split by one vantage point, and each side asks the other's border."""
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= _BLOCK:
        return _compare(p, a, b, radius, forest)
    v = p[a[0]]
    da, db = _distance(p[a], v).astype(int), _distance(p[b], v).astype(int)
    mu = int(np.median(np.concatenate([da, db])))
    parts = [
        (a[da <= mu], b[db <= mu]), (a[da > mu], b[db > mu]),
        (a[(da <= mu) & (da > mu - radius)], b[(db > mu) & (db <= mu + radius)]),
        (a[(da > mu) & (da <= mu + radius)], b[(db <= mu) & (db > mu - radius)]),
    ]
    if max(len(x) * len(y) for x, y in parts) > 0.9 * len(a) * len(b):
        return _compare(p, a, b, radius, forest)  # nothing to prune here
    for x, y in parts:
        _across(p, x, y, radius, forest)


def _tree(p: np.ndarray, points: np.ndarray, radius: int, forest: Forest) -> None:
    waiting = [points]
    while waiting:
        points = waiting.pop()
        if len(points) <= LEAF:
            _compare(p, points, points, radius, forest)
            continue
        d = _distance(p[points], p[points[0]]).astype(int)
        for i in points[d <= radius].tolist():
            forest.link(int(points[0]), i)
        mu = min(int(np.median(d)), int(d.max()) - 1)  # points are distinct, so both sides have some
        inner, outer = d <= mu, d > mu
        _across(p, points[inner & (d > mu - radius)], points[outer & (d <= mu + radius)], radius, forest)
        waiting += [points[inner], points[outer]]


def spanning_links(fingerprints: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Index pairs that join all distinct uint64 fingerprints linked within the radius."""
    forest = Forest(len(fingerprints))
    _tree(fingerprints, np.arange(len(fingerprints)), radius, forest)
    return forest.edges


def masks(radius: int = RADIUS, pieces: int = 6, bits: int = BITS) -> list[int]:
    """Bit masks of every choice of ``pieces - radius`` blocks."""
    edges = [bits * i // pieces for i in range(pieces + 1)]
    blocks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    return [sum(c) for c in combinations(blocks, pieces - radius)]


def near_links(fingerprints: DataFrame, radius: int = RADIUS, pieces: int = 6) -> DataFrame:
    """Links (a, b) between the distinct values of ``fp`` (long) that connect all pairs within the radius."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    shards = F.explode(F.array(*[
        F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"))
        for i, m in enumerate(masks(radius, pieces))
    ]))
    dealt = fingerprints.select("fp").distinct().select("fp", shards.alias("s")).select("s.t", "s.key", "fp")
    sorted_shards = dealt.repartition("t", "key").sortWithinPartitions("t", "key")

    def links(t: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        """Links of whole shards, which lie one after the other."""
        new = np.flatnonzero(np.r_[True, (t[1:] != t[:-1]) | (key[1:] != key[:-1])])
        size = np.diff(np.r_[new, len(fp)])
        a, b = [], []
        for n in range(2, LEAF + 1):  # small shards: all of one size at once
            starts = new[size == n]
            for i, j in combinations(range(n), 2) if len(starts) else ():
                near = np.bitwise_count(fp[starts + i] ^ fp[starts + j]) <= radius
                a.append(fp[starts[near] + i])
                b.append(fp[starts[near] + j])
        for start, n in zip(new[size > LEAF].tolist(), size[size > LEAF].tolist()):
            pairs = np.array(spanning_links(fp[start:start + n], radius), dtype=int).reshape(-1, 2)
            a.append(fp[start + pairs[:, 0]])
            b.append(fp[start + pairs[:, 1]])
        flat = lambda x: pa.array(np.concatenate(x).view(np.int64) if x else np.empty(0, np.int64))
        return pa.RecordBatch.from_arrays([flat(a), flat(b)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = [np.empty(0, np.int64)] * 3
        for batch in batches:
            cols = [np.concatenate([k, c.to_numpy(zero_copy_only=False).astype(np.int64)]) for k, c in zip(kept, batch.columns)]
            if not len(cols[0]):
                continue
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.argmax(same))  # the last shard may go on in the next batch
            if cut:
                yield links(cols[0][:cut], cols[1][:cut], cols[2][:cut].view(np.uint64))
            kept = [c[cut:] for c in cols]
        if len(kept[0]):
            yield links(kept[0], kept[1], kept[2].view(np.uint64))

    return sorted_shards.mapInArrow(run, "a long, b long").distinct()
