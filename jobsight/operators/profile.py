"""Dataset profile and target verdicts.

All counts per column come from one long histogram: one unpivot and one aggregate for the
whole table, whatever its number of columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from jobsight import fixed_values as fv
from jobsight.functions.naming import target_hint
from jobsight.functions.numbers import is_numeric, number_of
from jobsight.operators.ordered import exact_quantiles

#: Parts that the columns of a histogram are counted in, at most.
HISTOGRAM_PARTS = 16


def dtype_name(dtype: T.DataType) -> str:
    """The column type in the dataset profile's vocabulary."""
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, T.IntegralType):
        return "int64"
    if isinstance(dtype, T.NumericType):
        return "float64"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime64[ns]"
    return "object"


def column_facts(df: DataFrame) -> DataFrame:
    """One row per column from the schema alone: order, type and whether it is numeric."""
    rows = [
        (f.name, i, dtype_name(f.dataType), is_numeric(f.dataType)) for i, f in enumerate(df.schema.fields)
    ]
    return df.sparkSession.createDataFrame(rows, "column string, ordinal int, dtype string, is_numeric boolean")


def value_histogram(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A1: (column, value, n) for every value of every column, null included as a value.

    One aggregate over the cells of a few columns after the other, so that a task combines the values
    of few columns only. A table of files is read once in all, as a part reads its own columns; pass a
    staged table where the rows take long to make.
    """
    names = columns or df.columns
    parts = [names[i::HISTOGRAM_PARTS] for i in range(min(len(names), HISTOGRAM_PARTS))]
    cells = [
        df.select([F.col(c).cast("string").alias(c) for c in own]).unpivot([], own, "column", "value") for own in parts
    ]
    long = reduce(DataFrame.union, cells)
    return long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def column_counts(histogram: DataFrame) -> DataFrame:
    """Per column: rows, non-null rows, distinct values, smallest and largest class."""
    filled = F.col("value").isNotNull()
    return histogram.groupBy("column").agg(
        F.sum("n").alias("rows"),
        F.coalesce(F.sum(F.when(filled, F.col("n"))), F.lit(0)).alias("non_null_rows"),
        F.count("value").alias("unique_count"),
        F.coalesce(F.min(F.when(filled, F.col("n"))), F.lit(0)).alias("min_class_rows"),
        F.coalesce(F.max(F.when(filled, F.col("n"))), F.lit(0)).alias("max_class_rows"),
    )


def dataset_profile(df: DataFrame, top_n: int = 25) -> DataFrame:
    """A2: long table (section, name, value): size, type counts, top missing and top cardinality."""
    counts = column_counts(value_histogram(df))
    facts = column_facts(df)
    size = counts.agg(F.max("rows").alias("r")).select(
        F.lit("size").alias("section"), F.lit("rows").alias("name"), F.coalesce("r", F.lit(0)).cast("double").alias("value")
    )
    width = facts.agg(F.count(F.lit(1)).alias("c")).select(
        F.lit("size").alias("section"), F.lit("columns").alias("name"), F.col("c").cast("double").alias("value")
    )
    types = facts.groupBy("dtype").agg(F.count(F.lit(1)).alias("c")).select(
        F.lit("dtype_breakdown").alias("section"), F.col("dtype").alias("name"), F.col("c").cast("double").alias("value")
    )
    missing = (
        counts.select("column", (100 * (F.col("rows") - F.col("non_null_rows")) / F.col("rows")).alias("pct"))
        .orderBy(F.desc("pct"), "column").limit(top_n)
        .select(F.lit("top_missing_pct").alias("section"), F.col("column").alias("name"), F.round("pct", 2).alias("value"))
    )
    cardinality = (
        counts.orderBy(F.desc("unique_count"), "column").limit(top_n)
        .select(F.lit("top_cardinality").alias("section"), F.col("column").alias("name"),
                F.col("unique_count").cast("double").alias("value"))
    )
    return size.unionByName(width).unionByName(types).unionByName(missing).unionByName(cardinality)


def numeric_cells(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, number) for every cell that reads as a number; booleans are 0 and 1."""
    names = columns or df.columns
    return (
        df.select([number_of(df, c, loose=False).alias(c) for c in names])
        .unpivot([], names, "column", "number")
        .where("number is not null")
    )


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A3: count, min, max, mean, exact median, sample deviation (0 for one row) and number of
    distinct values of each column's numbers; columns without numbers have count 0."""
    names = columns or df.columns
    cells = numeric_cells(df, names)
    moments = cells.groupBy("column").agg(
        F.count("number").alias("valid_numeric_rows"),
        F.min("number").alias("min"),
        F.max("number").alias("max"),
        F.avg("number").alias("mean"),
        F.coalesce(F.stddev_samp("number"), F.lit(0.0)).alias("std"),
    )
    # Counting distinct numbers by grouping twice combines on the map side.
    distinct = cells.distinct().groupBy("column").agg(F.count("number").alias("numeric_unique_count"))
    median = exact_quantiles(cells, ["column"], "number", {"median": 0.5})
    every = df.sparkSession.createDataFrame([(c,) for c in names], "column string")
    return (
        every.join(moments, "column", "left").join(distinct, "column", "left").join(median, "column", "left")
        .fillna(0, ["valid_numeric_rows", "numeric_unique_count"])
    )


def top_classes(histogram: DataFrame, limit: int = 8) -> DataFrame:
    """A4: the largest classes of each column (column, class, n, place)."""
    largest = W.partitionBy("column").orderBy(F.desc("n"), "value")
    return (
        histogram.where("value is not null")
        .withColumn("place", F.row_number().over(largest))
        .where(F.col("place") <= limit)
        .select("column", F.col("value").alias("class"), "n", "place")
    )


def _verdict(task: Column, test_size: float) -> tuple[Column, Column]:
    """Reasons that block a target and warnings, as arrays of texts."""
    c = F.col
    text = lambda pattern, *args: F.format_string(pattern, *args)
    empty_text = text("Target is %.1f%% empty.", c("missing_raw"))
    regression, classes = task == "regression", task == "classification"
    test_rows = F.bround(c("non_null_rows") * F.lit(test_size), 0)
    train_rows = c("non_null_rows") - test_rows
    hint = c("problem_hint")
    reasons = [
        F.when(
            c("non_null_rows") < fv.MIN_TARGET_ROWS,
            text(f"Only %d non-empty target rows; at least {fv.MIN_TARGET_ROWS} are required.", c("non_null_rows")),
        ),
        F.when(c("unique_count") < 2, fv.REASON_FEW_DISTINCT),
        F.when(c("missing_raw") > 70, empty_text),
        F.when(
            regression & (c("valid_numeric_rows") < fv.MIN_TARGET_ROWS),
            text(
                f"Regression target has only %d numeric rows; at least {fv.MIN_TARGET_ROWS} are required.",
                c("valid_numeric_rows"),
            ),
        ),
        F.when(regression & (c("numeric_unique_count") < 5), fv.REASON_FEW_NUMBERS),
        F.when(regression & (hint == "identifier"), fv.REASON_IDENTIFIER_REGRESSION),
        F.when(classes & (c("min_class_rows") < 2), fv.REASON_SINGLE_ROW_CLASS),
        F.when(
            classes & ((c("unique_count") > fv.MAX_CLASSES) | (c("unique_ratio_raw") > fv.MAX_UNIQUE_RATIO)),
            fv.REASON_MANY_CLASSES,
        ),
        F.when(
            classes & ((test_rows < c("unique_count")) | (train_rows < c("unique_count"))),
            fv.REASON_SPLIT_TOO_SMALL,
        ),
        F.when(classes & (hint == "identifier"), fv.REASON_IDENTIFIER_CLASS),
    ]
    warnings = [
        F.when((c("missing_raw") > 30) & (c("missing_raw") <= 70), empty_text),
        F.when(regression & (hint == "date"), fv.WARNING_DATE_REGRESSION),
        F.when(classes & (hint == "date"), fv.WARNING_DATE_CLASS),
    ]
    return F.array_compact(F.array(*reasons)), F.array_compact(F.array(*warnings))


def target_profiles(
    df: DataFrame,
    columns: list[str] | None = None,
    forced_task: str | None = None,
    test_size: float = 0.2,
    max_items: int | None = None,
) -> DataFrame:
    """A5: one row per column: can it be a training target, as which task, and why not.

    F16: a numeric column with more than twenty distinct values is a regression target,
    anything else a classification target; ``forced_task`` overrides. ``max_items`` keeps the
    first columns only (the form asks for 250); by default all are judged.
    """
    names = (columns or df.columns)[:max_items]
    facts = column_facts(df).where(F.col("column").isin(names))
    numbers = numeric_summary(df, names)
    counts = column_counts(value_histogram(df, names))
    nothing = {c: 0 for c in ("rows", "non_null_rows", "unique_count", "min_class_rows", "max_class_rows")}
    base = facts.join(counts, "column", "left").fillna(nothing).join(numbers, "column", "left")
    recommended = F.when(
        F.col("is_numeric") & (F.col("unique_count") > fv.MAX_CLASSIFICATION_NUMBERS), "regression"
    ).otherwise("classification")
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    filled = base.select(
        "*",
        ratio(100.0 * (F.col("rows") - F.col("non_null_rows")), F.col("rows")).alias("missing_raw"),
        ratio(F.col("unique_count"), F.col("non_null_rows")).alias("unique_ratio_raw"),
        recommended.alias("recommended_task_type"),
        (F.lit(forced_task) if forced_task else recommended).alias("effective_task_type"),
        target_hint(F.col("column")).alias("problem_hint"),
    )
    reasons, warnings = _verdict(F.col("effective_task_type"), test_size)
    blocked, warned = F.size("reasons") > 0, F.size("warnings") > 0
    return (
        filled.withColumn("reasons", reasons)
        .withColumn("warnings", warnings)
        .select(
            "column", "ordinal", "dtype", "rows", "non_null_rows",
            F.round("missing_raw", 2).alias("missing_pct"), "unique_count",
            F.round("unique_ratio_raw", 4).alias("unique_ratio"), "recommended_task_type",
            "effective_task_type", "problem_hint", "min_class_rows", "max_class_rows",
            "valid_numeric_rows", "numeric_unique_count", "min", "max", "mean", "median", "std",
            "reasons", "warnings",
            (~blocked).alias("is_trainable"),
            F.when(blocked, "blocked").when(warned, "review").otherwise("ready").alias("quality"),
        )
    )


def target_candidates(profiles: DataFrame, limit: int | None = None) -> DataFrame:
    """Trainable columns in column order, all of them unless ``limit`` is given."""
    found = profiles.where("is_trainable").orderBy("ordinal").select("ordinal", "column")
    return found if limit is None else found.limit(limit)


def trainable_first(profiles: DataFrame, limit: int | None = None) -> DataFrame:
    """Headers with the trainable ones first, each part in column order; all unless ``limit`` is given."""
    found = profiles.orderBy(F.desc("is_trainable"), "ordinal").select(
        "column", "quality", "recommended_task_type", "is_trainable", "ordinal"
    )
    return found if limit is None else found.limit(limit)


def profile_rollup(profiles: DataFrame) -> DataFrame:
    """A22."""
    return profiles.agg(
        F.count(F.lit(1)).alias("columns"),
        F.count_if("is_trainable").alias("trainable_targets"),
        F.count_if(~F.col("is_trainable")).alias("blocked_headers"),
    )
