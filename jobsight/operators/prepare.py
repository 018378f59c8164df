"""Privacy-reduced dataset from a raw jobs export.

Sampling uses a hash order of the row key, so it is repeatable and does not depend on how
the rows are partitioned.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from jobsight import fixed_values as fv
from jobsight.functions import dates, numbers, status, text
from jobsight.functions.optional import column_or_null
from jobsight.operators.ordered import mix_order, number_rows


@dataclass(frozen=True)
class Policy:
    """How many rows the prepared dataset may hold and which columns order its rows."""

    row_key: list[str] = field(default_factory=lambda: ["project_no"])
    target_rows: int = fv.PREPARE_TARGET_ROWS
    top_teams: int = fv.PREPARE_TOP_TEAMS
    rows_per_team: int = fv.PREPARE_ROWS_PER_TEAM
    seed: int = fv.RANDOM_SEED


def complete_rows(df: DataFrame) -> DataFrame:
    """Rows with every (present) required column filled."""
    present = [F.col(c) for c in fv.REQUIRED_COLUMNS if c in df.columns]
    return df.where(text.all_filled(*present)) if present else df


def _team_text() -> Column:
    return F.coalesce(text.strip(F.col("related_contacts")), F.lit(""))


def top_teams(df: DataFrame, limit: int) -> DataFrame:
    """The most frequent whole team cells; equal counts in name order."""
    return (
        df.groupBy(_team_text().alias("_team")).agg(F.count(F.lit(1)).alias("team_jobs"))
        .orderBy(F.desc("team_jobs"), "_team").limit(limit)
    )


def of_top_teams(df: DataFrame, limit: int) -> DataFrame:
    """Rows of the most frequent teams, by a semi-join with at most ``limit`` names."""
    return df.withColumn("_team", _team_text()).join(top_teams(df, limit), "_team", "left_semi")


def is_priority(df: DataFrame) -> Column:
    """A finished or cancelled status, or any safety or damage signal."""
    worded = F.lower(F.coalesce(column_or_null(df, "status").cast("string"), F.lit(""))).rlike(
        fv.PRIORITY_STATUS_PATTERN
    )
    signals = [F.col(c) for c in fv.PRIORITY_SIGNAL_COLUMNS if c in df.columns]
    return (worded | text.any_filled(*signals)) if signals else worded


def sample_per_team(df: DataFrame, rows: int) -> DataFrame:
    """Up to ``rows`` rows of each team in hash order; Spark trims every team before the shuffle."""
    order = W.partitionBy("_team").orderBy("_order")
    return df.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= rows).drop("_place")


def sample_priority(df: DataFrame, rows: int) -> DataFrame:
    """Up to ``rows`` priority rows of the whole table in hash order, by a distributed top-k."""
    return df.where("_priority").orderBy("_order").limit(rows)


def whole_row(columns: list[str]) -> Column:
    """What tells rows apart: the digest of all cells, so rows without a number stay separate."""
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns])).cast("binary"))


def select_rows(df: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The rows of the prepared dataset.

    A sample per team united with a sample of priority rows; if that is more than the
    target, all chosen priority rows stay and the others fill the free places in hash order.
    """
    eligible = of_top_teams(complete_rows(df), policy.top_teams)
    key = [c for c in policy.row_key if c in df.columns]
    marked = (
        eligible.withColumn("_priority", is_priority(df)).withColumn("_row", whole_row(df.columns))
        .withColumn("_order", F.struct(mix_order(policy.seed, *key), F.col("_row")))
    )
    sampled = sample_per_team(marked, policy.rows_per_team).withColumn("_kept", F.lit(False))
    priority = sample_priority(marked, policy.target_rows // 3).withColumn("_kept", F.lit(True))
    # The flag says whether a row was chosen as a priority row.
    combined = (
        sampled.unionByName(priority)
        .withColumn("_kept", F.max("_kept").over(W.partitionBy("_row")))
        .dropDuplicates(["_row"])
    )
    # Kept rows sort before the remainder, so one limit does both.
    return combined.orderBy(F.desc("_kept"), "_order").limit(policy.target_rows).drop("_kept", "_order", "_priority", "_row")


def client_aliases(df: DataFrame) -> DataFrame:
    """(contact_name, alias) with Client 0001 for the most frequent client, ties by name."""
    counted = (
        df.select(text.blank_to_null(F.col("contact_name")).alias("contact_name")).where("contact_name is not null")
        .groupBy("contact_name").agg(F.count(F.lit(1)).alias("jobs"))
    )
    numbered = number_rows(counted, [F.desc("jobs"), F.asc("contact_name")], "number")
    return numbered.select("contact_name", _code("Client ", F.col("number"), 4).alias("alias"))


def number_jobs(df: DataFrame, row_key: list[str]) -> DataFrame:
    """Add ``job_number`` 1..n in the order (team, date, row key)."""
    start_at = dates.datetime_of(df, "date") if "date" in df.columns else F.lit(None).cast("timestamp_ntz")
    ordered = df.withColumn("_start_at", start_at).withColumn("_row", whole_row(df.columns))
    order = ["_team", "_start_at", *[c for c in row_key if c in df.columns], "_row"]
    return number_rows(ordered, [F.col(c) for c in order], "job_number").drop("_start_at", "_row")


def _code(prefix: str, number: Column, width: int = 6) -> Column:
    """Prefix and zero-padded number; longer numbers keep all digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), F.lit("0")))


def privacy_reduced(selected: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Selected rows as the safe dataset: kept columns only (P1), client aliases (J2), status
    group, new job codes, outward postcodes, typed dates and cleaned numbers."""
    numbered = number_jobs(selected, policy.row_key)
    if "contact_name" in selected.columns:
        aliases = client_aliases(selected)
        numbered = (
            numbered.withColumn("contact_name", text.blank_to_null(F.col("contact_name")))
            .join(aliases, "contact_name", "left")
            .withColumn("contact_name", F.coalesce("alias", F.lit("Client Unknown")))
        )
    number = F.col("job_number")
    replaced = {
        "project_no": _code("JOB-", number),
        "project_name": _code("Project ", number),
        "related_contacts": F.col("_team"),
        "c_homeownerpostcode": text.outward_postcode(F.col("c_homeownerpostcode")),
    }
    columns = []
    for name in [c for c in fv.KEEP_COLUMNS if c in selected.columns]:
        if name in replaced:
            value = replaced[name]
        elif name in fv.DATE_COLUMNS:
            value = dates.datetime_of(selected, name).cast("date")
        elif name in fv.NUMERIC_COLUMNS:
            value = numbers.numeric_strict(F.col(name))
        else:
            value = F.col(name)
        columns.append(value.alias(name))
        if name == "status":
            columns.append(status.status_group(F.col(name)).alias("status_group"))
    return numbered.select(*columns)


def in_output_order(safe: DataFrame) -> DataFrame:
    """A distributed sort by team, date and job code."""
    return safe.orderBy("related_contacts", "date", "project_no")


def manifest(
    source: DataFrame, selected: DataFrame, safe: DataFrame, policy: Policy = Policy(), output_rows: int | None = None
) -> DataFrame:
    """One row that records what the build read, kept and dropped. ``output_rows`` are those
    that the write of ``safe`` has counted; without them they are counted here."""
    written = safe.agg(F.count(F.lit(1)).alias("output_rows")) if output_rows is None else safe.sparkSession.createDataFrame(
        [(output_rows,)], "output_rows long"
    )
    rows_in = source.agg(F.count(F.lit(1)))
    aliases = client_aliases(selected).agg(F.count(F.lit(1))) if "contact_name" in selected.columns else None
    dropped = [c for c in fv.PRIVATE_COLUMNS if c in source.columns]
    kept = [c for c in fv.KEEP_COLUMNS if c in source.columns]
    texts = lambda names: F.array(*[F.lit(n) for n in names]).cast("array<string>")
    return written.select(
        rows_in.scalar().alias("source_rows"),
        F.lit(len(source.columns)).cast("long").alias("source_columns"),
        "output_rows",
        F.lit(len(safe.columns)).cast("long").alias("output_columns"),
        (aliases.scalar() if aliases is not None else F.lit(0).cast("long")).alias("client_aliases"),
        F.lit(policy.top_teams).alias("top_teams"),
        F.lit(policy.rows_per_team).alias("max_rows_per_team"),
        F.lit(policy.target_rows).alias("target_rows"),
        texts(dropped).alias("dropped_columns"),
        texts(kept).alias("kept_columns"),
    )


def status_group_counts(safe: DataFrame) -> DataFrame:
    return safe.groupBy("status_group").agg(F.count(F.lit(1)).alias("jobs"))
