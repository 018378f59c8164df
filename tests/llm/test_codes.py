"""Vector codes against brute force."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from jobsight.llm import grid_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, entries, rounds, parts=4):
    good = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    common = Counter(len(r[1]) for r in good)
    length = min(common, key=lambda n: (-common[n], n), default=0)
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], label) for i, v, label in good if len(v) == length]
    cuts = [c.tolist() for c in np.array_split(np.arange(length), parts)]
    vectors = [[[v[j] for j in cut] for cut in cuts] for _, v, _ in good]
    first = sorted(range(len(good)), key=lambda r: (good[r][0] is None, good[r][0] or 0, good[r][1]))[:entries]
    books = [[vectors[r][p] for r in first] for p in range(parts)]
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    place = lambda p, w: min(range(len(books[p])), key=lambda e: (square(books[p][e], w), e))
    for _ in range(rounds):
        members = defaultdict(list)
        for v in vectors:
            for p, w in enumerate(v):
                members[p, place(p, w)].append(w)
        books = [[[sum(x) // len(x) for x in zip(*members[p, e])] if members[p, e] else b for e, b in enumerate(book)] for p, book in enumerate(books)]
    coded = []
    for (i, _, label), v in zip(good, vectors):
        index = [place(p, w) for p, w in enumerate(v)]
        coded.append((i, label, "".join(f"{e:02x}" for e in index), sum(square(books[p][e], w) for p, (e, w) in enumerate(zip(index, v)))))
    totals = Counter()
    for _, label, _, error in coded:
        totals[label] += error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return Counter((i, code, error, totals[label], digest) for i, label, code, error in coded)



def vectors(width, n=120):
    rng = random.Random(width)
    point = lambda: [rng.gauss(0, 0.3) for _ in range(width)]
    hot = point()
    rows = [(i, point(), rng.choice([1, 1, 1, 2, None])) for i in range(n)]
    rows += [(1000 + i, hot, 1) for i in range(n // 2)]  # copies
    rows += [(7, point(), 2), (7, rows[7][1], 2), (7, rows[7][1], 2), (None, point(), None), (None, point(), 3)]  # equal and null ids
    rows += [(2000, None, 1), (2001, [None] * width, 1), (2002, [float("nan")] * width, 1), (2003, [float("inf")] * width, 1), (2004, [0.5], 1)]
    rows += [(2005, [0.0] * width, 1), (2006, [-0.0] * width, 9), (2007, [100.0] * width, 9)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("width, entries", [(8, 16), (64, 32), (7, 16), (4, 1)])
def test_codes(spark, width, entries):
    rows = vectors(width)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    frame = frame.selectExpr("*", "1 AS v", "2 AS code", "3 AS error", "4 AS part", "5 AS n", "6 AS _salt")
    got = grid_codes.vector_codes(frame, entries)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert Counter(map(tuple, got.collect())) == brute(rows, entries, 4)


def test_empty_and_few(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert grid_codes.vector_codes(empty).count() == 0
    assert grid_codes.vector_codes(spark.createDataFrame([(1, None, 1), (2, [None], 1)], SCHEMA)).count() == 0
    rows = [(1, [1.0, 2.0, 3.0, 4.0], None), (2, [1.0, 2.0, 3.0, 5.0], None), (3, [9.0, 2.0, 3.0, 5.0], 4)]
    assert Counter(map(tuple, grid_codes.vector_codes(spark.createDataFrame(rows, SCHEMA)).collect())) == brute(rows, 256, 4)
    none = [(1, [], 1), (2, [], 1)]
    assert {r["code"] for r in grid_codes.vector_codes(spark.createDataFrame(none, SCHEMA)).collect()} == {"00000000"}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.integers(1, 9), st.integers(1, 80), st.integers(1, 30))
def test_kept_entries_hold_the_nearest(seed, n, width, step, memo):
    """Whatever the side of a box and the size of the memo, with many ties."""
    rng = np.random.default_rng(seed)
    entries, points = rng.integers(-6, 6, (n, width)) * 10, rng.integers(-70, 70, (200, width))
    grid = grid_codes.Grid(entries, step, memo)
    for half in (points[:100], points[100:], points[:100]):
        index, far = grid.nearest(half)
        exact = ((half[:, None] - entries[None]) ** 2).sum(axis=2)
        assert index.tolist() == exact.argmin(axis=1).tolist() and far.tolist() == exact.min(axis=1).tolist()


def test_known_boxes_are_not_tested_again():
    points = np.repeat(np.random.default_rng(1).integers(-50, 50, (20, 4)), 50, axis=0)
    grid = grid_codes.Grid(np.random.default_rng(2).integers(-50, 50, (64, 4)), 8)
    grid.nearest(points)
    boxes, compared = grid.boxes, grid.compared
    grid.nearest(points)
    assert grid.boxes == boxes <= 20 and compared < len(points) * 64 / 3
