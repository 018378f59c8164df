"""Ranked search against brute force."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pytest

from jobsight.llm import term_pipeline

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = [
    (1, "the of THE river17 stone2, lamp5 lamp5 garden9"), (2, "stupid3 idiot4 the1"), (2, "stupid3 idiot4 the1"), (2, "paper11"),
    (3, None), (4, "nothing-like-this Ünïcode 日本語 É don't"), (None, "two three one"), (5, "..."), (6, "xxx " * 50 + "of1 to2"),
    *[(10 + i, f"the{i} of{i} and{i} to{i + 1} lamp{i} is{i} it{i}") for i in range(20)],
]


def tokens(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(docs, items, k):
    held = [(i, Counter(tokens(t)), len(tokens(t))) for i, t in docs if tokens(t)]
    total, df = sum(n for _, _, n in held), Counter(t for _, c, _ in held for t in c)
    out = Counter()
    for item_id, text in {(i, t or "") for i, t in items}:
        scores = []
        for doc_id, counts, n in held:
            m = 100 - 25 + (25 * n * len(held)) // total
            score = 0
            for term in tokens(text):
                if term in counts:
                    w = math.floor(1000 * math.log((2 * len(held) + 2) / (2 * df[term] + 1)))
                    score += w * ((10**9 * counts[term]) // (1000 * counts[term] + 12 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out.update((item_id, rank, doc_id, -score) for rank, (score, _, _, doc_id) in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1))
    return out


@pytest.mark.parametrize("owners, bundle, parts", [(4, 256, 5), (1, 3, 1), (7, 5, 13)])
def test_search(spark, docs, doc_rows, owners, bundle, parts):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 AS item", "2 AS term", "3 AS weight")
    for k in (20, 3):
        got = term_pipeline.search(docs.repartition(parts), items, k, owners, bundle)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert Counter(map(tuple, got.collect())) == brute(doc_rows, ITEMS, k)


def test_empty_tables(spark, docs, empty):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert term_pipeline.search(empty, items).count() == 0
    assert term_pipeline.search(docs, items.limit(0)).count() == 0
    assert term_pipeline.search(docs, items.where("item_id in (3, 5)")).count() == 0


def test_terms_of_long_texts():
    text = "Aé-b_9 " * 500_000
    assert term_pipeline.terms(text.encode()) == {"aé".encode(): 500_000, b"b": 500_000, b"9": 500_000}


def test_block_rows():
    block = term_pipeline._Block()
    for doc_id, text in [(9, b"b a b"), (None, b"a"), (3, b"b c")]:
        block.add(doc_id, term_pipeline.terms(text))
    head, *parts = block.rows(7, at_once=2)
    assert head["ids"] == [[3, 9, None]] and head["total"] == [6] and head["n"] == [3] and len(parts) == 2
    found = {t: [np.frombuffer(p[c][i], d).tolist() for c, d in (("places", "<u2"), ("counts", "<u4"), ("lengths", "<u4"))]
             for p in parts for i, t in enumerate(p["term"])}
    assert found == {b"b": [[0, 1], [1, 2], [2, 3]], b"c": [[0], [1], [2]], b"a": [[1, 2], [1, 1], [3, 1]]}
