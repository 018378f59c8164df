"""Baseline signature of a feature table and drift of another table against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from jobsight import fixed_values as fv
from jobsight.functions.numbers import is_numeric
from jobsight.operators.ordered import exact_quantiles
from jobsight.operators.profile import numeric_cells, value_histogram

SIGNATURE = (
    "feature string, type string, mean double, std double, q1 double, q3 double, "
    "top_distribution map<string,double>"
)


def _columns(df: DataFrame, numeric: bool) -> list[str]:
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) == numeric]


def category_shares(df: DataFrame, columns: list[str], limit: int = fv.SIGNATURE_CATEGORIES) -> DataFrame:
    """(feature, value, share) of the most frequent values; null counts as MISSING and the
    share is of all rows, so the mass beyond the limit is not seen."""
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, value string, share double")
    filled = df.select([F.coalesce(F.col(c).cast("string"), F.lit("MISSING")).alias(c) for c in columns])
    histogram = value_histogram(filled)
    totals = histogram.groupBy("column").agg(F.sum("n").alias("total"))
    largest = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        histogram.withColumn("place", F.row_number().over(largest))
        .where(F.col("place") <= limit)
        .join(totals, "column")
        .select(F.col("column").alias("feature"), "value", (F.col("n") / F.col("total")).alias("share"))
    )


def numeric_moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, std) of numeric columns; a column without values has mean 0, deviation 0."""
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, mean double, std double")
    every = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    found = numeric_cells(df, columns).groupBy(F.col("column").alias("feature")).agg(
        F.avg("number").alias("mean"), F.stddev_samp("number").alias("std")
    )
    return every.join(found, "feature", "left").fillna(0.0, ["mean", "std"])


def baseline_signature(df: DataFrame, max_categories: int = fv.SIGNATURE_CATEGORIES) -> DataFrame:
    """One row per feature."""
    numeric, other = _columns(df, True), _columns(df, False)
    quartiles = (
        exact_quantiles(numeric_cells(df, numeric), ["column"], "number", {"q1": 0.25, "q3": 0.75})
        .withColumnRenamed("column", "feature")
        if numeric
        else df.sparkSession.createDataFrame([], "feature string, q1 double, q3 double")
    )
    numbers = (
        numeric_moments(df, numeric).join(quartiles, "feature", "left").fillna(0.0, ["q1", "q3"])
        .select("feature", F.lit("numeric").alias("type"), "mean", "std", "q1", "q3",
                F.lit(None).cast("map<string,double>").alias("top_distribution"))
    )
    none = F.lit(None).cast("double")
    shares = category_shares(df, other, max_categories).groupBy("feature").agg(
        F.map_from_entries(F.collect_list(F.struct("value", "share"))).alias("top_distribution")
    )
    every = df.sparkSession.createDataFrame([(c,) for c in other], "feature string")
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    categories = every.join(shares, "feature", "left").select(
        "feature", F.lit("categorical").alias("type"), none.alias("mean"), none.alias("std"),
        none.alias("q1"), none.alias("q3"), F.coalesce("top_distribution", empty).alias("top_distribution"),
    )
    return numbers.unionByName(categories)


def stored(signature: DataFrame) -> DataFrame:
    """A signature as a table of its rows, so that what it was computed from is read once. It has
    one row per column with at most 25 shares, whatever the size of the data."""
    return signature.sparkSession.createDataFrame(signature.select(*[c.split()[0] for c in SIGNATURE.split(", ")]).collect(), SIGNATURE)


def share_differences(signature: DataFrame, current: DataFrame) -> DataFrame:
    """Baseline and current shares side by side for the union of their categories."""
    signature = stored(signature)
    names = [r.feature for r in signature.where("type = 'categorical'").collect() if r.feature in current.columns]
    before = signature.where(F.col("feature").isin(names)).select(
        "feature", F.explode("top_distribution").alias("value", "baseline_share")
    )
    now = category_shares(current, names).withColumnRenamed("share", "current_share")
    return before.join(now, ["feature", "value"], "full_outer").fillna(0.0, ["baseline_share", "current_share"])


def drift_by_feature(signature: DataFrame, current: DataFrame, threshold: float = fv.DRIFT_ALERT) -> DataFrame:
    """A20 per feature. Numeric: mean shift in baseline deviations, a third of it, at most 1.
    Categorical: total variation between the top shares. A feature the current data lacks
    scores 1. Text in a numeric feature is parsed, unreadable text is null.

    The signature, one row per column, is computed once, when the plan is made.
    """
    signature = stored(signature)
    kinds = {r.feature: r.type for r in signature.select("feature", "type").collect()}
    present = [f for f in kinds if f in current.columns]
    numeric = [f for f in present if kinds[f] == "numeric"]
    now = numeric_moments(current, numeric).select("feature", F.col("mean").alias("current_mean"))
    variation = share_differences(signature, current).groupBy("feature").agg(
        (0.5 * F.sum(F.abs(F.col("baseline_share") - F.col("current_share")))).alias("variation")
    )
    is_number = F.col("type") == "numeric"
    missing = ~F.col("feature").isin(present)
    shift = F.abs(F.col("current_mean") - F.col("mean")) / F.greatest(F.col("std"), F.lit(1e-6))
    score = (
        F.when(missing, 1.0).when(is_number, F.least(F.lit(1.0), shift / 3.0))
        .otherwise(F.coalesce("variation", F.lit(0.0)))
    )
    return (
        signature.join(now, "feature", "left").join(variation, "feature", "left")
        .withColumn("drift_score", score)
        .select(
            "feature", F.col("type").alias("feature_type"), "drift_score",
            F.when(~missing & is_number, F.col("mean")).alias("baseline_mean"),
            F.when(~missing & is_number, F.col("current_mean")).alias("current_mean"),
            F.when(missing, "missing_in_current_data").when(F.col("drift_score") >= threshold, "drifted")
            .otherwise("stable").alias("status"),
        )
    )


def drift_summary(by_feature: DataFrame, threshold: float = fv.DRIFT_ALERT) -> DataFrame:
    """Overall score (plain mean), alert flag and number of drifted features."""
    overall = F.coalesce(F.avg("drift_score"), F.lit(0.0))
    return by_feature.agg(
        overall.alias("overall_drift_score"),
        F.lit(float(threshold)).alias("alert_threshold"),
        (overall >= threshold).alias("is_alert"),
        F.count_if(F.col("status") != "stable").alias("drifted_feature_count"),
        F.count(F.lit(1)).alias("total_features_checked"),
    )


def top_drifted(by_feature: DataFrame, limit: int = 25) -> DataFrame:
    """T4."""
    return by_feature.where("status <> 'stable'").orderBy(F.desc("drift_score"), "feature").limit(limit)
