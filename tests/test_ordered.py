"""Distributed order statistics against brute force."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsight.operators import metrics, ordered
from jobsight.operators.ordered import band_totals, exact_quantiles, flag_smallest, mix_order, running_totals


@pytest.fixture(scope="module")
def facts():
    rng = random.Random(7)
    hot = [("hot", round(rng.choice([rng.uniform(-50, 50), rng.lognormvariate(8, 2), 100.0]), 2)) for _ in range(3000)]
    cold = [(f"k{i % 40}", round(rng.uniform(0, 1000), 1)) for i in range(1500)]
    return hot + cold + [("one", 5.0), ("nulls", None)]


def by_key(facts):
    groups = {}
    for key, value in facts:
        if value is not None:
            groups.setdefault(key, []).append(value)
    return groups


def test_value_bin_keeps_order(spark):
    values = sorted([-1e12, -5.5, -5.4, -1e-9, 0.0, 1e-9, 0.5, 1.0, 1.001, 99.0, 1e6, 1e18, 1e300])
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    bins = [r[0] for r in rows.select(ordered.value_bin(F.col("v")), "v").orderBy("v").collect()]
    assert bins == sorted(bins)


def test_exact_quantiles(spark, facts):
    df = spark.createDataFrame(facts, "k string, v double").repartition(5)
    got = exact_quantiles(df, ["k"], "v", {"q1": 0.25, "median": 0.5, "q3": 0.75, "top": 1.0}).collect()
    groups = by_key(facts)
    assert {r.k for r in got} == set(groups)
    for row in got:
        want = np.quantile(groups[row.k], [0.25, 0.5, 0.75, 1.0])
        assert np.allclose([row.q1, row.median, row.q3, row.top], want, rtol=1e-12)


@pytest.mark.parametrize("small_group", [10 ** 9, 30, 0])
def test_quantiles_of_sized_groups_are_those_of_bins(spark, monkeypatch, small_group):
    rng = random.Random(8)
    rows = [(g, rng.choice([None, -0.0, 0.0, 2.5, rng.uniform(-9, 9e6)]), rng.randint(1, 4)) for g, n in (("a", 90), ("b", 25), ("c", 1), (None, 9)) for _ in range(n)]
    df = spark.createDataFrame([*rows, ("none", None, 1)], "g string, v double, n long")
    sizes = df.where("v is not null").groupBy("g").agg(F.sum("n").alias("_rows"), F.count("v").alias("_points"))
    wanted = {"low": 0.1, "median": 0.5, "top": 1.0}
    plain = sorted(map(str, ordered.exact_quantiles(df.where("g is not null"), ["g"], "v", wanted, "n").collect()))
    monkeypatch.setattr(ordered, "SMALL_GROUP", small_group)
    assert sorted(map(str, ordered.quantiles_of_sized(df, sizes, ["g"], "v", wanted, "n").collect())) == plain


def test_exact_quantiles_of_whole_table(spark, facts):
    df = spark.createDataFrame(facts, "k string, v double")
    got = exact_quantiles(df, [], "v", {"median": 0.5})
    assert got.columns == ["median"]
    assert got.first().median == pytest.approx(np.median([v for _, v in facts if v is not None]))


def test_running_totals(spark, facts):
    df = spark.createDataFrame([f for f in facts if f[1] is not None], "k string, v double").withColumn("n", F.lit(1))
    groups = by_key(facts)
    for row in running_totals(df, ["k"], "v", ["n"]).collect():
        assert row.n == groups[row.k].count(row.v)
        assert row.below_n == sum(1 for x in groups[row.k] if x < row.v)


@pytest.mark.parametrize("small_group", [10 ** 9, 100, 1])
def test_band_totals(spark, facts, small_group, monkeypatch):
    """Whole groups, binned groups and a mix give the same exact sums."""
    monkeypatch.setattr(ordered, "SMALL_GROUP", small_group)
    rng = random.Random(3)
    groups = by_key(facts)
    sizes = {k: len(v) for k, v in groups.items()}
    asked = []
    for i in range(300):
        key = rng.choice(["hot", "hot", "one", "k1", "k7", "absent"])
        low = rng.choice([rng.uniform(-60, 5000), 100.0, 5.0, 3.3])
        asked.append((i, key, low, low + rng.choice([0.0, 1.0, 500.0, -1.0]), sizes.get(key, 0)))
    probes = spark.createDataFrame(asked, "id long, k string, low double, high double, size long")
    df = spark.createDataFrame(facts, "k string, v double").withColumns({"n": F.lit(1), "w": F.round("v").cast("long")})
    got = {r.id: r for r in band_totals(df, probes, ["k"], "v", "low", "high", ["n", "w"], ["id"], "size").collect()}
    for i, key, low, high, _ in asked:
        if low > high:
            assert i not in got
            continue
        hits = [x for x in groups.get(key, []) if low <= x <= high]
        assert got[i].n == len(hits)


def test_crowded_groups_are_salted(spark, monkeypatch):
    """More probes than a task should hold: the group is repeated per salt, results stay the same."""
    monkeypatch.setattr(ordered, "SMALL_GROUP", 50)
    facts = spark.createDataFrame([("g", float(i)) for i in range(40)] + [("h", 1.0)], "k string, v double").withColumn("n", F.lit(1))
    probes = spark.createDataFrame(
        [(i, "g", float(i % 60) - 5, float(i % 60), 40) for i in range(400)] + [(400, "h", 0.0, 2.0, 1)],
        "id long, k string, low double, high double, size long")
    got = {r.id: r.n for r in band_totals(facts, probes, ["k"], "v", "low", "high", ["n"], ["id"], "size").collect()}
    assert got == {**{i: sum(i % 60 - 5 <= x <= i % 60 for x in range(40)) for i in range(400)}, 400: 1}


def test_number_rows(spark):
    rows = [("hot" if i % 2 else f"c{i % 9}", (i * 37) % 1001) for i in range(1001)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(11)
    got = ordered.number_rows(df, [F.desc("k"), F.col("v")], "n").orderBy("n").collect()
    want = sorted(rows, key=lambda r: r[1])
    want.sort(key=lambda r: r[0], reverse=True)
    assert [r.n for r in got] == list(range(1, 1002)) and [(r.k, r.v) for r in got] == want


def test_flag_smallest_is_exact(spark):
    rows = [(i, "hot" if i % 3 else f"c{i % 5}") for i in range(2000)]
    df = spark.createDataFrame(rows, "i long, k string")
    quota = {"hot": 400, "c0": 0, "c1": 7, "c2": 10 ** 6, "c3": 1, "c4": 20}
    marked = df.withColumn("h", mix_order(42, "i")).withColumn(
        "q", F.create_map(*[x for k, v in quota.items() for x in (F.lit(k), F.lit(v))])[F.col("k")]
    )
    got = {r.i for r in flag_smallest(marked.repartition(7), ["k"], "h", "q", "chosen").where("chosen").collect()}
    want = set()
    for key, most in quota.items():
        ids = [i for i, k in rows if k == key]
        ids.sort(key=lambda i: hashlib.md5(f"42|{i}".encode()).hexdigest())
        want |= set(ids[:most])
    assert got == want


def test_split_is_stratified_and_repeatable(spark):
    df = spark.createDataFrame([(i, "abc"[min(i % 7, 2)]) for i in range(997)], "i long, y string")
    one = metrics.split_rows(df, "y", ["i"], 0.2, 42, True, 997)
    two = metrics.split_rows(df.repartition(9, "y"), "y", ["i"], 0.2, 42, True, 997)
    test_rows = {r.i for r in one.where("is_test").collect()}
    assert test_rows == {r.i for r in two.where("is_test").collect()}
    assert len(test_rows) == 200 and one.count() == 997
    shares = one.groupBy("y").agg(F.avg(F.col("is_test").cast("int")).alias("s")).collect()
    assert all(abs(r.s - 0.2) < 0.01 for r in shares)


def test_roc_auc_against_pairs(spark):
    rng = random.Random(1)
    rows = [(rng.random() < 0.4, round(rng.random(), 1)) for _ in range(400)]
    got = metrics.roc_auc(spark.createDataFrame(rows, "p boolean, s double"), "p", "s").first().roc_auc
    pos, neg = [s for p, s in rows if p], [s for p, s in rows if not p]
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert got == pytest.approx(want)
    assert metrics.roc_auc(spark.createDataFrame([(True, 0.5)], "p boolean, s double"), "p", "s").first().roc_auc is None


def test_rows_with_the_same_last_key(spark):
    """Exactly the quota is marked where rows share a key, and whole rows are not shuffled."""
    df = spark.createDataFrame([(i, "k", f"{i % 4:032x}") for i in range(40)], "i long, k string, h string").withColumn("q", F.lit(25))
    marked = flag_smallest(df.repartition(5), ["k"], "h", "q", "chosen")
    rows = marked.collect()
    assert len(rows) == 40 and sum(r.chosen for r in rows) == 25
    assert all(r.chosen == (int(r.h, 16) < 2) for r in rows if int(r.h, 16) != 2)
    whole = metrics.split_rows(df.drop("q"), "k", ["h"], 0.5, 1, False, 40)
    assert whole.where("is_test").count() == 20 and whole.columns == ["i", "k", "h", "is_test"]
