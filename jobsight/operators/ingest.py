"""One cast pass from a normalized jobs table (text or typed) to the canonical typed table.

Every domain operator reads the canonical form, so blanks, dates, prices and status words
are interpreted once. Columns the input lacks are typed nulls. Unused columns are pruned
by Catalyst, so the wide projection costs nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobsight import fixed_values as fv
from jobsight.functions import dates, numbers, status, text
from jobsight.functions.optional import column_or_null


def _number(df: DataFrame, name: str) -> Column:
    return numbers.number_of(df, name) if name in df.columns else F.lit(None).cast("double")


def _datetime(df: DataFrame, name: str) -> Column:
    return dates.datetime_of(df, name) if name in df.columns else F.lit(None).cast("timestamp_ntz")


def _hours(df: DataFrame, name: str) -> Column:
    return dates.duration_hours_of(df, name) if name in df.columns else F.lit(None).cast("double")


def canonical_jobs(df: DataFrame) -> DataFrame:
    """Typed jobs with parsed teams, dates, money, status flags and event flags."""
    state = column_or_null(df, "status")
    contacts = column_or_null(df, "related_contacts")
    hse_category = text.any_filled(column_or_null(df, "c_hscategory"))
    hse_dated = _datetime(df, "c_hsincidentdate").isNotNull()
    riddor = F.coalesce(_number(df, "c_riddorreportable") > 0, F.lit(False))
    damage = {c: text.any_filled(column_or_null(df, c)) for c in fv.DAMAGE_COLUMNS}
    parsed = df.select(
        column_or_null(df, "project_no").cast("string").alias("project_no"),
        column_or_null(df, "project_name").cast("string").alias("project_name"),
        column_or_null(df, "contact_name").cast("string").alias("client"),
        F.lower(column_or_null(df, "contact_name").cast("string")).alias("client_key"),
        text.list_parts(contacts).alias("teams"),
        state.cast("string").alias("status"),
        status.is_active(state).alias("is_active"),
        status.says_cancelled(state).alias("is_cancelled"),
        status.is_completed(state).alias("is_completed"),
        status.says_completed(state).alias("says_completed"),
        _datetime(df, "date").alias("start_at"),
        _datetime(df, "due_date").alias("due_at"),
        _datetime(df, "completed_date").alias("completed_at"),
        _number(df, "budget_revenue").alias("budget_revenue"),
        _number(df, "actual_revenue").alias("actual_revenue"),
        _number(df, "budget_cost").alias("budget_cost"),
        _number(df, "actual_cost").alias("actual_cost"),
        _hours(df, "total_to_do").alias("to_do_hours"),
        _hours(df, "total_done").alias("done_hours"),
        column_or_null(df, "budget_type").cast("string").alias("budget_type"),
        column_or_null(df, "c_homeownerpostcode").cast("string").alias("postcode"),
        text.outward_postcode(column_or_null(df, "c_homeownerpostcode")).alias("area"),
        F.lower(column_or_null(df, "c_scaffoldpurpose").cast("string")).alias("job_type_key"),
        hse_category.alias("hse_category"),
        hse_dated.alias("hse_dated"),
        riddor.alias("riddor"),
        *[flag.alias(name) for name, flag in damage.items()],
    )
    # A second step, so that each cell is parsed once however often it is used.
    return parsed.select(
        "*",
        text.distinct_keys(F.col("teams")).alias("team_keys"),
        dates.whole_days(F.col("start_at"), F.col("completed_at")).alias("cycle_days"),
        (F.col("hse_category") | F.col("hse_dated") | F.col("riddor")).alias("hse_event"),
        (F.col("c_damagestatus") | F.col("c_damagecategory") | F.col("c_damagedescription")).alias("damage_event"),
    )


def canonical_intake(df: DataFrame, job_id: str = "job_id") -> DataFrame:
    """Typed intake jobs: partner, job type, area, price, cost and lead time.

    ``row_id`` tells the rows of this table apart, whatever their job ids; store the table
    where several results of it are joined.
    """

    def pick(names: list[str]) -> Column:
        return text.first_filled(*[column_or_null(df, n) for n in names])

    partner = text.blank_to_null(column_or_null(df, "related_contacts"))
    job_type = pick(fv.JOB_TYPE_FIELDS)
    postcode = pick(fv.POSTCODE_FIELDS)
    parsed = df.select(
        F.col(job_id).cast("string").alias("job_id"),
        partner.alias("partner"),
        F.lower(partner).alias("team_key"),
        text.blank_to_null(column_or_null(df, "contact_name")).alias("client"),
        job_type.alias("job_type"),
        F.lower(job_type).alias("job_type_key"),
        postcode.alias("postcode"),
        text.outward_postcode(postcode).alias("area"),
        dates.parse_datetime(pick(fv.START_FIELDS)).alias("start_at"),
        dates.parse_datetime(pick(fv.DUE_FIELDS)).alias("due_at"),
        numbers.first_price(*[column_or_null(df, n) for n in fv.PRICE_FIELDS]).alias("price"),
        numbers.numeric_loose(column_or_null(df, "budget_cost")).alias("cost"),
    )
    lead = dates.whole_days(F.col("start_at"), F.col("due_at"))
    return parsed.withColumns({"lead_days": lead, "row_id": F.monotonically_increasing_id()}).drop("start_at", "due_at")


def intake_readiness(df: DataFrame, job_id: str = "job_id") -> DataFrame:
    """how many of the required inputs a row has, and which are missing."""
    checks = [
        F.when(text.blank_to_null(column_or_null(df, name)).isNull(), F.lit(label))
        for name, label in fv.REQUIRED_INPUTS
    ]
    missing = F.array_compact(F.array(*checks))
    total = len(checks)
    present = F.lit(total) - F.size(missing)
    return df.select(
        F.col(job_id).cast("string").alias("job_id"),
        present.cast("long").alias("present"),
        F.round(present * 100 / F.lit(total)).cast("long").alias("ready_pct"),
        F.array_join(missing, ", ").alias("missing"),
        (F.size(missing) == 0).alias("is_ready"),
    )
