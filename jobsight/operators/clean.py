"""Cleaning and typing of a raw table.

What to do with a column is decided from one aggregate over all columns; the casts then
run in one projection. Only those per-column counts reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from jobsight import fixed_values as fv
from jobsight.functions import dates, numbers, text
from jobsight.functions.naming import snake_columns


@dataclass
class CleaningPlan:
    """The decision for every column, kept so that later data is cleaned the same way."""

    rows: int = 0
    empty: list[str] = field(default_factory=list)
    to_date: list[str] = field(default_factory=list)
    to_number: list[str] = field(default_factory=list)
    to_boolean: list[str] = field(default_factory=list)


def tidy_text(df: DataFrame) -> DataFrame:
    """trimmed text columns with blanks and ``nan`` as null."""
    return df.select([
        text.missing_to_null(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
        for f in df.schema.fields
    ])


def column_tests(df: DataFrame) -> DataFrame:
    """One row per column: filled, date-like, numeric and boolean cell counts, from one pass.

    Cells become rows of one text column first, so each test is compiled once, not once per column.
    """
    cells = []
    for f in df.schema.fields:
        kind = (
            "text" if isinstance(f.dataType, T.StringType) else "date" if dates.is_datetime(f.dataType)
            else "boolean" if isinstance(f.dataType, T.BooleanType) else "number" if numbers.is_numeric(f.dataType) else "other"
        )
        cells.append(F.struct(F.lit(f.name).alias("column"), F.lit(kind).alias("kind"), F.col(f.name).cast("string").alias("value")))
    kind, value = F.col("kind"), F.col("value")
    return (
        df.select(F.inline(F.array(*cells)))
        .groupBy("column", "kind")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.count("value").alias("filled"),
            F.count_if(F.when(kind == "text", dates.parse_datetime(value).isNotNull()).otherwise((kind == "date") & value.isNotNull())).alias("dated"),
            F.count_if(
                F.when(kind == "text", numbers.numeric_text(value).isNotNull())
                .otherwise(kind.isin("number", "boolean") & value.isNotNull())
            ).alias("numeric"),
            F.count_if(((kind == "boolean") | numbers.boolean_text(value)) & value.isNotNull()).alias("boolean"),
        )
        .select("column", (kind == "text").alias("is_text"), "rows", "filled", "dated", "numeric", "boolean")
    )


def decisions(tests: DataFrame) -> DataFrame:
    """What happens to each column.

    Empty columns go (P9). More than half the rows dates makes a date column (F6). More
    than 90 percent of the rows numbers makes a text column numeric (F3); typed numbers
    stay. All filled cells 0 or 1 makes a boolean column (F12).
    """
    c = F.col
    dated = c("dated") > 0.5 * c("rows")
    numeric = ~dated & (c("numeric") > 0) & (~c("is_text") | (c("numeric") > 0.9 * c("rows")))
    boolean = ~dated & (c("filled") > 0) & (c("boolean") == c("filled"))
    return tests.select(
        "*",
        F.when(c("filled") == 0, "empty").when(boolean, "boolean").when(dated, "date").when(numeric, "number")
        .otherwise("text").alias("decision"),
    )


def plan_cleaning(df: DataFrame) -> CleaningPlan:
    """Decide every column of a tidied table."""
    plan = CleaningPlan()
    kinds = {"empty": plan.empty, "date": plan.to_date, "number": plan.to_number, "boolean": plan.to_boolean}
    found = {r.column: r for r in decisions(column_tests(df)).collect()}
    for name in df.columns:
        if name not in found:  # a table without rows
            plan.empty.append(name)
            continue
        plan.rows = found[name].rows
        kinds.get(found[name].decision, []).append(name)
    return plan


def apply_cleaning(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    """Cast every column as decided, tidy the postcode (F10) and add the yes/no column."""

    def cleaned(name: str) -> Column:
        c, dtype = F.col(name), df.schema[name].dataType
        if name in plan.to_date:
            return dates.datetime_of(df, name)
        if name in plan.to_boolean:
            return c if isinstance(dtype, T.BooleanType) else numbers.to_boolean(c)
        if name in plan.to_number:
            return numbers.numeric_text(c) if isinstance(dtype, T.StringType) else c.cast("double")
        return text.compact_postcode(c) if name == "c_homeownerpostcode" else c

    kept = [c for c in df.columns if c not in plan.empty]
    columns = [cleaned(c).alias(c) for c in kept]
    if "c_edgeprotection" in kept:
        columns.append(text.yes_no(F.col("c_edgeprotection")).alias("c_edgeprotection_normalized"))
    return df.select(*columns)


def clean_table(raw: DataFrame) -> tuple[DataFrame, CleaningPlan]:
    """Snake-case names, tidy, decide, cast, drop duplicate rows."""
    tidy = tidy_text(snake_columns(raw))
    plan = plan_cleaning(tidy)
    return apply_cleaning(tidy, plan).dropDuplicates(), plan


def counted_while_written(typed: DataFrame) -> tuple[DataFrame, Observation]:
    """The typed table without duplicate rows, and what its write will have seen: ``rows_before``
    and ``rows_after``. Both are counted behind the shuffle, in the tasks that write, so a task
    that runs again counts once."""
    seen = Observation("cleaning")
    groups = typed.groupBy(*[F.col(f"`{c}`") for c in typed.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    return groups.observe(seen, F.sum("_copies").alias("rows_before"), F.count(F.lit(1)).alias("rows_after")).drop("_copies"), seen


def cleaning_log(typed: DataFrame, cleaned: DataFrame, plan: CleaningPlan) -> DataFrame:
    """One row per dropped or converted column and one for the duplicate rows.

    ``typed`` is the table before, ``cleaned`` the table after the duplicates went.
    """
    after = cleaned.agg(F.count(F.lit(1)).alias("n"))
    return _log(plan, typed.agg(F.count(F.lit(1)).alias("rows_before")).select("rows_before", after.scalar().alias("rows_after")))


def written_log(spark: SparkSession, plan: CleaningPlan, seen: Observation) -> DataFrame:
    """S7 from the counts of a finished write."""
    counts = [(seen.get["rows_before"] or 0, seen.get["rows_after"])]
    return _log(plan, spark.createDataFrame(counts, "rows_before long, rows_after long"))


def _log(plan: CleaningPlan, counts: DataFrame) -> DataFrame:
    steps = [("drop_empty", c) for c in plan.empty] + [("to_date", c) for c in plan.to_date]
    steps += [("to_number", c) for c in plan.to_number] + [("to_boolean", c) for c in plan.to_boolean]
    log = counts.sparkSession.createDataFrame(steps, "step string, column string").select(
        "step", "column", F.lit(None).cast("long").alias("rows_before"), F.lit(None).cast("long").alias("rows_after")
    )
    return log.unionByName(counts.select(
        F.lit("drop_duplicates").alias("step"), F.lit(None).cast("string").alias("column"), "rows_before", "rows_after"
    ))
