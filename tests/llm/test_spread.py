"""Joins with one row per key, when a key holds much of the rows."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobsight.llm import spread


def by_key(rows):
    return rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))


@pytest.mark.parametrize("parts", [1, 3, 1000])
def test_every_row_finds_its_one(spark, tmp_path, parts):
    """With all, some and no keys frequent; null keys and keys without a partner are left out."""
    data = [("hot", i) for i in range(300)] + [(f"k{i % 50}", i) for i in range(600)] + [(None, 1), ("alone", 2)]
    rows = spark.createDataFrame(data, "k string, v long").withColumn("_kept", F.lit("x"))
    by_key(rows.where("k != 'alone'")).write.parquet(f"{tmp_path}/ones")
    ones = spark.read.parquet(f"{tmp_path}/ones")
    got = spread.join_one(rows, ones, "k", "n", F.xxhash64("v"), parts)
    assert got.columns == ["k", "v", "_kept", "n", "least"]
    want = Counter()
    for k, v in data[:-2]:
        own = [b for a, b in data if a == k]
        want[k, v, "x", len(own), min(own)] += 1
    assert Counter(tuple(r) for r in got.collect()) == want


def test_a_third_of_all_rows_in_one_key(spark, tmp_path):
    """No task of the join gets much more than its share."""
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    by_key(rows).write.parquet(f"{tmp_path}/ones")
    ones = spark.read.parquet(f"{tmp_path}/ones")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        joined = spread.join_one(rows, ones, "k", "n", F.xxhash64("v"))
        tasks = [r["count"] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(tasks) == 30_000 and len(tasks) == 16 and max(tasks) < 1.3 * 30_000 / 16


def test_empty(spark, tmp_path):
    rows = spark.createDataFrame([], "k string, v long")
    by_key(rows).write.parquet(f"{tmp_path}/ones")
    assert spread.join_one(rows, spark.read.parquet(f"{tmp_path}/ones"), "k", "n", F.xxhash64("v")).count() == 0
