"""Mixing: targets against a plain reckoning, rounding by its promises."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from jobsight.llm import mixing


def reckoned_targets(sizes, weights=(3, 1, 2), share=1.5):
    """Targets by repeated sharing of what is above twice the size."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, goal = set(), share * sum(sizes.values())
    while True:
        left = sum(weight[s] for s in names if s not in full)
        level = (goal - sum(2 * sizes[s] for s in full)) / left if left else 0
        above = {s for s in names if s not in full and weight[s] * level > 2 * sizes[s]}
        if not above:
            return {s: 2 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= above


def test_mix(docs):
    rows = mixing.mix_sources(docs).collect()
    given = docs.select("doc_id", "source", "text").collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in rows) == Counter((r["doc_id"], r["source"], count(r["text"])) for r in given)
    sizes, largest, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
    want = reckoned_targets(dict(sizes))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= largest[s] + 1e-6


def test_reruns_agree(docs):
    once, again = (Counter(map(tuple, mixing.mix_sources(d).select("doc_id", "size", "taken").collect())) for d in (docs, docs.repartition(3)))
    assert once == again


def test_mixed_rows_are_the_plan(docs):
    plan = mixing.mix_sources(docs)
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    want = Counter()
    for r in plan.collect():
        want[r["doc_id"], r["source"]] += r["copies"]
    assert Counter((r["doc_id"], r["source"]) for r in rows.collect()) == +want


def test_rounding_keeps_sums_and_expectations(spark):
    """Over many seeds an item is taken as often as its fraction says; each sum is right up to one item."""
    items = spark.createDataFrame([(p, i, float(1 + i % 7), 0.3 if p else 0.75) for p in (0, 1) for i in range(100)], "place long, item long, weight double, x double")
    items = items.withColumn("block", F.col("item") % 13).cache()
    hits = defaultdict(float)
    for seed in range(8):
        out = mixing.pivotal_rounding(items, 13, seed, fanin=4).join(items.select("place", "item", "weight"), ["place", "item"]).collect()
        assert len(out) == 200 and {r["x"] for r in out} <= {0.0, 1.0}
        for p, x in ((0, 0.75), (1, 0.3)):
            mine = [r for r in out if r["place"] == p]
            assert abs(sum(r["x"] * r["weight"] for r in mine) - x * sum(r["weight"] for r in mine)) <= 7
            hits[p] += sum(r["x"] for r in mine) / 800
    assert hits[0] == pytest.approx(0.75, abs=0.05) and hits[1] == pytest.approx(0.3, abs=0.05)


def test_main_path_is_native(docs):
    plan = mixing.mix_sources(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty(empty):
    assert mixing.mix_sources(empty).count() == 0
    assert mixing.mixed_rows(empty).count() == 0
    blank = empty.sparkSession.createDataFrame([(1, None, None, None, None)], empty.schema)
    assert [r["taken"] for r in mixing.mix_sources(blank).collect()] == [0]
