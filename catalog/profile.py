"""Dataset profile, target verdict and drift queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import RAW, query, raw_jobs, rounded, table
from jobsight.operators import drift, profile

_DTYPES = {
    "date": "datetime64[ns]", "due_date": "datetime64[ns]", "completed_date": "datetime64[ns]",
    "budget_revenue": "float64", "budget_cost": "float64", "actual_revenue": "float64", "actual_cost": "float64",
    "c_riddorreportable": "int64",
}
_COLUMNS = (
    "project_no project_name contact_name project_manager related_contacts date due_date completed_date status "
    "budget_type budget_revenue budget_cost actual_revenue actual_cost total_to_do c_homeownerpostcode "
    "c_scaffoldpurpose c_locationofscaffold c_hscategory c_hsincidentdate c_riddorreportable c_damagestatus "
    "c_damagecategory raw_price_text raw_date_text"
).split()
_FACTS = ", ".join(f"('{c}', {i}, '{_DTYPES.get(c, 'object')}')" for i, c in enumerate(_COLUMNS))

HIST = RAW + """, texts AS (
  SELECT COLUMNS(*)::VARCHAR FROM raw
), long AS (
  SELECT "column", value FROM texts UNPIVOT INCLUDE NULLS (value FOR "column" IN (COLUMNS(*)))
), hist AS (
  SELECT "column", value, count(*) AS n FROM long GROUP BY ALL
), per_column AS (
  SELECT "column", CAST(sum(n) AS BIGINT) AS rows, CAST(coalesce(sum(n) FILTER (WHERE value IS NOT NULL), 0) AS BIGINT) AS non_null_rows,
         count(value) AS unique_count, coalesce(min(n) FILTER (WHERE value IS NOT NULL), 0) AS min_class_rows,
         coalesce(max(n) FILTER (WHERE value IS NOT NULL), 0) AS max_class_rows
  FROM hist GROUP BY "column"
), facts AS (
  SELECT * FROM (VALUES """ + _FACTS + """) AS t("column", ordinal, dtype)
), every_cell AS (
  SELECT "column", TRY_CAST(value AS DOUBLE) AS number FROM long
  WHERE regexp_matches(value, '^[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?$')
), numbers AS (
  SELECT "column", count(*) AS valid_numeric_rows, min(number) AS min, max(number) AS max, avg(number) AS mean,
         coalesce(stddev_samp(number), 0) AS std, median(number) AS median, count(DISTINCT number) AS numeric_unique_count
  FROM every_cell GROUP BY "column"
)"""

_VERDICT = HIST + """, base AS (
  SELECT f.*, p.* EXCLUDE ("column"), coalesce(valid_numeric_rows, 0) AS valid_numeric_rows,
         coalesce(numeric_unique_count, 0) AS numeric_unique_count,
         100.0::DOUBLE * (rows - non_null_rows) / rows AS missing_raw,
         CASE WHEN non_null_rows > 0 THEN unique_count / non_null_rows ELSE 0 END AS ratio,
         CASE WHEN dtype IN ('int64', 'float64', 'bool') AND unique_count > 20 THEN 'regression' ELSE 'classification' END AS task,
         CASE WHEN regexp_matches(lower("column"), 'date|time|created|updated|completed|due') THEN 'date'
              WHEN regexp_matches(lower("column"), '(^|_)(id|uuid|guid|number|no|name)$') THEN 'identifier' ELSE 'standard' END AS hint
  FROM facts f JOIN per_column p USING ("column") LEFT JOIN numbers USING ("column")
), judged AS (
  SELECT *, round_even(non_null_rows * 0.2::DOUBLE, 0) AS test_rows, CASE
    WHEN TRUE THEN list_filter([
      CASE WHEN non_null_rows < 30 THEN 'Only ' || non_null_rows || ' non-empty target rows; at least 30 are required.' END,
      CASE WHEN unique_count < 2 THEN 'Target has fewer than two distinct values.' END,
      CASE WHEN missing_raw > 70 THEN printf('Target is %.1f%% empty.', missing_raw) END,
      CASE WHEN task = 'regression' AND valid_numeric_rows < 30 THEN 'Regression target has only ' || valid_numeric_rows || ' numeric rows; at least 30 are required.' END,
      CASE WHEN task = 'regression' AND numeric_unique_count < 5 THEN 'Regression target needs at least five distinct numeric values.' END,
      CASE WHEN task = 'regression' AND hint = 'identifier' THEN 'Target looks like an identifier or name rather than a measurable outcome.' END,
      CASE WHEN task = 'classification' AND min_class_rows < 2 THEN 'At least one class has only one row, so a stable train/test split is not possible.' END,
      CASE WHEN task = 'classification' AND (unique_count > 80 OR ratio > 0.35) THEN 'Target has too many distinct classes for a useful classification model; choose a grouped outcome.' END,
      CASE WHEN task = 'classification' AND (round_even(non_null_rows * 0.2::DOUBLE, 0) < unique_count
           OR non_null_rows - round_even(non_null_rows * 0.2::DOUBLE, 0) < unique_count) THEN 'There are too many classes for the selected test size.' END,
      CASE WHEN task = 'classification' AND hint = 'identifier' THEN 'Target looks like an identifier or name rather than an outcome.' END
    ], lambda x: x IS NOT NULL) END AS reasons,
    list_filter([
      CASE WHEN missing_raw > 30 AND missing_raw <= 70 THEN printf('Target is %.1f%% empty.', missing_raw) END,
      CASE WHEN task = 'regression' AND hint = 'date' THEN 'Date-like targets should usually be converted into duration or delay targets first.' END,
      CASE WHEN task = 'classification' AND hint = 'date' THEN 'Date-like targets usually perform better as engineered delay or duration outcomes.' END
    ], lambda x: x IS NOT NULL) AS warnings
  FROM base
), verdict AS (
  SELECT "column", ordinal, dtype, rows, non_null_rows, round(missing_raw, 2) AS missing_pct, unique_count,
         round(ratio, 4) AS unique_ratio, task AS recommended_task_type, task AS effective_task_type, hint AS problem_hint,
         coalesce(array_to_string(reasons, ' '), '') AS reasons, coalesce(array_to_string(warnings, ' '), '') AS warnings,
         len(reasons) = 0 AS is_trainable,
         CASE WHEN len(reasons) > 0 THEN 'blocked' WHEN len(warnings) > 0 THEN 'review' ELSE 'ready' END AS quality
  FROM judged
)"""


@query("a1_value_histogram", HIST + ' SELECT "column", value, n FROM hist')
def value_histogram(spark, sf):
    return profile.value_histogram(raw_jobs(spark, sf))


@query(
    "a2_dataset_profile",
    HIST + """, missing AS (
      SELECT "column", 100.0::DOUBLE * (rows - non_null_rows) / rows AS pct FROM per_column ORDER BY pct DESC, "column" LIMIT 25
    ), wide AS (SELECT "column", unique_count FROM per_column ORDER BY unique_count DESC, "column" LIMIT 25)
    SELECT 'size' AS section, 'rows' AS name, CAST(max(rows) AS DOUBLE) AS value FROM per_column
    UNION ALL SELECT 'size', 'columns', CAST(count(*) AS DOUBLE) FROM facts
    UNION ALL SELECT 'dtype_breakdown', dtype, CAST(count(*) AS DOUBLE) FROM facts GROUP BY dtype
    UNION ALL SELECT 'top_missing_pct', "column", round(pct, 2) FROM missing
    UNION ALL SELECT 'top_cardinality', "column", CAST(unique_count AS DOUBLE) FROM wide""",
)
def dataset_profile(spark, sf):
    return profile.dataset_profile(raw_jobs(spark, sf))


@query(
    "a3_numeric_summary",
    HIST + """ SELECT f."column", coalesce(valid_numeric_rows, 0) AS valid_numeric_rows, min, max, round(mean, 4) AS mean,
      round(std, 4) AS std, round(median, 4) AS median, coalesce(numeric_unique_count, 0) AS numeric_unique_count
      FROM facts f LEFT JOIN numbers n ON f."column" = n."column" """,
)
def numeric_summary(spark, sf):
    return profile.numeric_summary(raw_jobs(spark, sf)).select(
        "column", "valid_numeric_rows", "min", "max", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        F.round("median", 4).alias("median"), "numeric_unique_count",
    )


@query(
    "a4_class_summary",
    HIST + ' SELECT "column", unique_count AS class_count, min_class_rows, max_class_rows FROM per_column',
)
def class_summary(spark, sf):
    return profile.column_counts(profile.value_histogram(raw_jobs(spark, sf))).select(
        "column", F.col("unique_count").alias("class_count"), "min_class_rows", "max_class_rows"
    )


@query(
    "a4_top_classes",
    HIST + """ SELECT "column", value AS class, n, CAST(row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS INT) AS place
      FROM hist WHERE value IS NOT NULL QUALIFY place <= 8""",
)
def top_classes(spark, sf):
    return profile.top_classes(profile.value_histogram(raw_jobs(spark, sf)))


def profiles(spark, sf, **options):
    return profile.target_profiles(raw_jobs(spark, sf), **options)


@query("a5_target_profile", _VERDICT + " SELECT * FROM verdict")
def target_profile(spark, sf):
    return profiles(spark, sf).select(
        "column", F.col("ordinal").cast("long").alias("ordinal"), "dtype", "rows", "non_null_rows", "missing_pct",
        "unique_count", "unique_ratio", "recommended_task_type", "effective_task_type", "problem_hint",
        F.array_join("reasons", " ").alias("reasons"), F.array_join("warnings", " ").alias("warnings"),
        "is_trainable", "quality",
    )


@query(
    "a6_target_candidates",
    _VERDICT + ' SELECT "column", ordinal FROM verdict WHERE is_trainable ORDER BY ordinal LIMIT 150',
)
def target_candidates(spark, sf):
    return profile.target_candidates(profiles(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(
    "t6_headers_trainable_first",
    _VERDICT + """ SELECT "column", quality, recommended_task_type, is_trainable, ordinal FROM verdict
      ORDER BY is_trainable DESC, ordinal LIMIT 80""",
)
def headers(spark, sf):
    return profile.trainable_first(profiles(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query(
    "a22_profile_rollup",
    _VERDICT + """ SELECT count(*) AS columns, count(*) FILTER (WHERE is_trainable) AS trainable_targets,
      count(*) FILTER (WHERE NOT is_trainable) AS blocked_headers FROM verdict""",
)
def profile_rollup(spark, sf):
    return profile.profile_rollup(profiles(spark, sf))


@query(
    "f16_task_type",
    _VERDICT + ' SELECT "column", recommended_task_type FROM verdict',
)
def task_type(spark, sf):
    return profiles(spark, sf).select("column", "recommended_task_type")


@query("f17_target_hint", _VERDICT + ' SELECT "column", problem_hint FROM verdict')
def hints(spark, sf):
    return profiles(spark, sf).select("column", "problem_hint")


# --- drift: the first half of the events by time against the second half -------------------

_HALVES = """WITH halves AS (
  SELECT *, epoch_us(ts) < (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 FROM events) AS is_first FROM events
), cells AS (
  SELECT is_first, 'value' AS feature, value AS number FROM halves
  UNION ALL SELECT is_first, 'user_id', CAST(user_id AS DOUBLE) FROM halves
), moments AS (
  SELECT is_first, feature, avg(number) AS mean, stddev_samp(number) AS std, quantile_cont(number, 0.25) AS q1,
         quantile_cont(number, 0.75) AS q3 FROM cells GROUP BY ALL
), texts AS (
  SELECT is_first, 'event_type' AS feature, coalesce(event_type, 'MISSING') AS value FROM halves
  UNION ALL SELECT is_first, 'props', coalesce(props, 'MISSING') FROM halves
), counted AS (
  SELECT is_first, feature, value, count(*) AS n FROM texts GROUP BY ALL
), shares AS (
  SELECT is_first, feature, value, n / sum(n) OVER (PARTITION BY is_first, feature) AS share,
         row_number() OVER (PARTITION BY is_first, feature ORDER BY n DESC, value) AS place
  FROM counted QUALIFY place <= 25
), pairs AS (
  SELECT coalesce(b.feature, c.feature) AS feature, coalesce(b.value, c.value) AS value,
         coalesce(b.share, 0) AS baseline_share, coalesce(c.share, 0) AS current_share
  FROM (SELECT * FROM shares WHERE is_first) b FULL JOIN (SELECT * FROM shares WHERE NOT is_first) c
    ON b.feature = c.feature AND b.value = c.value
), scored AS (
  SELECT b.feature, 'numeric' AS feature_type, least(1.0, abs(c.mean - b.mean) / greatest(b.std, 1e-6) / 3) AS drift_score,
         b.mean AS baseline_mean, c.mean AS current_mean
  FROM moments b JOIN moments c ON b.feature = c.feature AND b.is_first AND NOT c.is_first
  UNION ALL
  SELECT feature, 'categorical', 0.5 * sum(abs(baseline_share - current_share)), NULL, NULL FROM pairs GROUP BY feature
  UNION ALL SELECT 'event_hour', 'numeric', 1.0, NULL, NULL
), report AS (
  SELECT *, CASE WHEN feature = 'event_hour' THEN 'missing_in_current_data' WHEN drift_score >= 0.35 THEN 'drifted' ELSE 'stable' END AS status
  FROM scored
)"""


def event_halves(spark, sf):
    """(baseline, current): features of the earlier and the later half of the event time span.

    The baseline has one feature more, which the current data lacks.
    """
    events = table(spark, sf, "events").withColumn("at_us", F.unix_micros(F.col("ts").cast("timestamp")))
    middle = events.agg(F.floor((F.min("at_us") + F.max("at_us")) / 2)).scalar()
    marked = events.withColumn("is_first", F.col("at_us") < middle)
    features = ["value", "user_id", "event_type", "props"]
    first = marked.where("is_first").select(*features, F.hour("ts").alias("event_hour"))
    return first, marked.where("not is_first").select(*features)


@query(
    "a19_baseline_signature",
    _HALVES + f""" SELECT feature, 'numeric' AS type, {rounded('mean', 6)} AS mean, {rounded('std', 6)} AS std,
      {rounded('q1', 6)} AS q1, {rounded('q3', 6)} AS q3 FROM moments WHERE is_first""",
)
def signature_numbers(spark, sf):
    first, _ = event_halves(spark, sf)
    return drift.baseline_signature(first.drop("event_hour")).where("type = 'numeric'").select(
        "feature", "type", *[F.round(c, 6).alias(c) for c in ("mean", "std", "q1", "q3")]
    )


@query(
    "a19_baseline_shares",
    _HALVES + " SELECT feature, value, share FROM shares WHERE is_first",
)
def signature_shares(spark, sf):
    first, _ = event_halves(spark, sf)
    return drift.baseline_signature(first).where("type = 'categorical'").select(
        "feature", F.explode("top_distribution").alias("value", "share")
    )


@query("j3_share_differences", _HALVES + " SELECT feature, value, baseline_share, current_share FROM pairs")
def share_differences(spark, sf):
    first, second = event_halves(spark, sf)
    return drift.share_differences(drift.baseline_signature(first), second)


@query(
    "u4_category_union",
    _HALVES + " SELECT feature, count(*) AS categories FROM pairs GROUP BY feature",
)
def category_union(spark, sf):
    first, second = event_halves(spark, sf)
    pairs = drift.share_differences(drift.baseline_signature(first), second)
    return pairs.groupBy("feature").agg(F.count(F.lit(1)).alias("categories"))


def drift_rows(spark, sf):
    first, second = event_halves(spark, sf)
    return drift.drift_by_feature(drift.baseline_signature(first), second)


@query(
    "a20_drift_by_feature",
    _HALVES + """ SELECT feature, feature_type, round(drift_score, 8) AS drift_score, round(baseline_mean, 6) AS baseline_mean,
      round(current_mean, 6) AS current_mean, status FROM report""",
)
def drift_by_feature(spark, sf):
    return drift_rows(spark, sf).select(
        "feature", "feature_type", F.round("drift_score", 8).alias("drift_score"),
        F.round("baseline_mean", 6).alias("baseline_mean"), F.round("current_mean", 6).alias("current_mean"), "status",
    )


@query(
    "a20_drift_summary",
    _HALVES + """ SELECT round(avg(drift_score), 8) AS overall_drift_score, 0.35::DOUBLE AS alert_threshold,
      avg(drift_score) >= 0.35 AS is_alert, count(*) FILTER (WHERE status <> 'stable') AS drifted_feature_count,
      count(*) AS total_features_checked FROM report""",
)
def drift_summary(spark, sf):
    return drift.drift_summary(drift_rows(spark, sf)).withColumn("overall_drift_score", F.round("overall_drift_score", 8))


@query(
    "t4_top_drifted",
    _HALVES + """ SELECT feature, round(drift_score, 8) AS drift_score, status FROM report WHERE status <> 'stable'
      ORDER BY drift_score DESC, feature LIMIT 25""",
)
def top_drifted(spark, sf):
    return drift.top_drifted(drift_rows(spark, sf)).select("feature", F.round("drift_score", 8).alias("drift_score"), "status")
