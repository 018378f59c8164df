"""Column function, predicate and file queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import JOBS, RAW, jobs, query, raw_jobs, rounded, table
from jobsight import fixed_values as fv
from jobsight.functions import dates, naming, numbers, optional, status, text
from jobsight.operators import features
from jobsight.session import scratch_path
from jobsight.sources import files

_KEPT = [
    "project_no", "project_name", "contact_name", "date", "due_date", "completed_date", "status", "total_to_do",
    "budget_revenue", "actual_revenue", "budget_cost", "actual_cost", "related_contacts", "c_homeownerpostcode",
    "c_locationofscaffold", "c_scaffoldpurpose", "c_hsincidentdate", "c_hscategory", "c_riddorreportable",
    "c_damagestatus", "c_damagecategory",
]


def on_raw(name: str, sql: str, *columns):
    """Register a row-level query: ``columns`` builds Spark expressions, ``sql`` the same in DuckDB."""

    @query(name, RAW + f" SELECT project_no, {sql} FROM raw")
    def run(spark, sf):
        return raw_jobs(spark, sf).select("project_no", *[c() for c in columns])

    return run


c = F.col
on_raw(
    "f1_numeric_loose",
    "CASE WHEN regexp_matches(raw_price_text, '[0-9]') THEN CAST(regexp_replace(raw_price_text, '[^0-9.-]', '', 'g') AS DOUBLE) END AS price",
    lambda: numbers.numeric_loose(c("raw_price_text")).alias("price"),
)
on_raw(
    "f2_numeric_strict",
    "CASE WHEN raw_price_text = 'n/a' THEN NULL WHEN starts_with(raw_price_text, '(') "
    "THEN -CAST(trim(raw_price_text, '()') AS DOUBLE) ELSE CAST(trim(raw_price_text, '£') AS DOUBLE) END AS price",
    lambda: numbers.numeric_strict(c("raw_price_text")).alias("price"),
)
on_raw(
    "f4_parse_datetime",
    "coalesce(try_strptime(raw_date_text, '%Y-%m-%d'), try_strptime(raw_date_text, '%d/%m/%Y')) AS parsed",
    lambda: dates.parse_datetime(c("raw_date_text")).alias("parsed"),
)
on_raw(
    "f5_clean_date",
    "CAST(coalesce(try_strptime(raw_date_text, '%Y-%m-%d'), try_strptime(raw_date_text, '%d/%m/%Y')) AS DATE) AS cleaned",
    lambda: dates.clean_date(c("raw_date_text")).alias("cleaned"),
)
on_raw(
    "f7_duration_hours",
    "round((CAST(split_part(total_to_do, ':', 1) AS DOUBLE) * 3600 + CAST(split_part(total_to_do, ':', 2) AS DOUBLE) * 60) / 3600, 6) AS hours",
    lambda: F.round(dates.duration_hours(c("total_to_do")), 6).alias("hours"),
)
on_raw(
    "f8_outward_simple",
    "split_part(upper(trim(c_homeownerpostcode)), ' ', 1) AS outward",
    lambda: text.outward_simple(c("c_homeownerpostcode")).alias("outward"),
)
on_raw(
    "f9_outward_postcode",
    "split_part(c_homeownerpostcode, ' ', 1) AS spaced, "
    "regexp_extract(replace(c_homeownerpostcode, ' ', ''), '^[A-Z]{1,2}\\d[A-Z\\d]?') AS compact",
    lambda: text.outward_postcode(c("c_homeownerpostcode")).alias("spaced"),
    lambda: text.outward_postcode(F.translate("c_homeownerpostcode", " ", "")).alias("compact"),
)
on_raw(
    "f10_compact_postcode",
    "upper(replace(c_homeownerpostcode, ' ', '')) AS compact",
    lambda: text.compact_postcode(c("c_homeownerpostcode")).alias("compact"),
)
on_raw(
    "f11_yes_no",
    "CASE WHEN c_riddorreportable = 1 THEN 'Yes' WHEN c_riddorreportable = 0 THEN 'No' "
    "ELSE CAST(c_riddorreportable AS VARCHAR) END AS answer",
    lambda: text.yes_no(F.concat(F.lit(" "), c("c_riddorreportable").cast("string"))).alias("answer"),
)
on_raw(
    "f13_missing_to_null",
    "CASE WHEN raw_price_text = 'n/a' THEN NULL ELSE raw_price_text END AS price_text",
    lambda: text.missing_to_null(
        F.when(c("raw_price_text") == "n/a", " nan ").otherwise(F.concat(F.lit(" "), c("raw_price_text"), F.lit("\t")))
    ).alias("price_text"),
)
on_raw(
    "f18_pct",
    f"{rounded('least(100, greatest(0, CAST(actual_revenue AS DOUBLE) / CAST(budget_revenue AS DOUBLE) * 100))', 1)} AS share",
    lambda: numbers.pct(c("actual_revenue").cast("double") / c("budget_revenue").cast("double")).alias("share"),
)
on_raw(
    "f19_risk_level",
    "CASE WHEN c_riddorreportable >= 2 THEN 'High' WHEN c_riddorreportable >= 1 THEN 'Medium' "
    "WHEN c_riddorreportable IS NOT NULL THEN 'Low' ELSE 'Low' END AS level",
    lambda: numbers.risk_level(c("c_riddorreportable"), 2, 1).alias("level"),
)
on_raw(
    "f24_cycle_days",
    "completed_date - date AS cycle_days",
    lambda: dates.whole_days(c("date"), c("completed_date")).alias("cycle_days"),
)
on_raw(
    "f25_variance_pct",
    f"CASE WHEN abs(budget_revenue) > 1e-9 THEN {rounded('(CAST(actual_revenue AS DOUBLE) - CAST(budget_revenue AS DOUBLE)) / CAST(budget_revenue AS DOUBLE) * 100', 4)} ELSE 0 END AS variance",
    lambda: F.round(
        numbers.variance_pct(c("actual_revenue").cast("double"), c("budget_revenue").cast("double")), 4
    ).alias("variance"),
)
on_raw(
    "p3_any_filled",
    "c_hscategory IS NOT NULL OR c_damagestatus IS NOT NULL OR c_damagecategory IS NOT NULL AS any_signal",
    lambda: text.any_filled(c("c_hscategory"), c("c_damagestatus"), c("c_damagecategory")).alias("any_signal"),
)
on_raw(
    "p4_status_flags",
    "regexp_matches(lower(status), 'booked|planned|awaiting|rts|request|sent') AND NOT regexp_matches(lower(status), 'cancel|postponed') AS active, "
    "regexp_matches(lower(status), 'cancel|postponed') AS cancelled, "
    "regexp_matches(lower(status), 'down|completed|complete|closed|handed over') AND NOT regexp_matches(lower(status), 'cancel|postponed') AS completed",
    lambda: status.is_active(c("status")).alias("active"),
    lambda: status.says_cancelled(c("status")).alias("cancelled"),
    lambda: status.is_completed(c("status")).alias("completed"),
)
on_raw(
    "p5_status_group",
    "CASE WHEN regexp_matches(lower(status), 'cancel|postponed') THEN 'cancelled' "
    "WHEN regexp_matches(lower(status), 'down|completed|complete|closed|handed over') THEN 'completed' "
    "WHEN regexp_matches(lower(status), 'booked|planned|awaiting|rts|request|sent') THEN 'active' ELSE 'other' END AS status_group",
    lambda: status.status_group(c("status")).alias("status_group"),
)


@query(
    "f14_split_entities",
    JOBS + " SELECT project_no, unnest(teams) AS team FROM jobs",
)
def split_entities(spark, sf):
    return raw_jobs(spark, sf).select("project_no", F.explode(text.list_parts(c("related_contacts"))).alias("team"))


@query(
    "f23_valid_dates",
    JOBS + " SELECT team_key, count(*) FILTER (WHERE hse_dated) AS valid_dates FROM hist GROUP BY team_key",
)
def valid_dates(spark, sf):
    cells = raw_jobs(spark, sf).select(
        F.explode(text.list_keys(c("related_contacts"))).alias("team_key"), "c_hsincidentdate"
    )
    return cells.groupBy("team_key").agg(F.count_if(dates.valid_date(c("c_hsincidentdate"))).alias("valid_dates"))


@query("p1_keep_columns", RAW + f" SELECT {', '.join(_KEPT)} FROM raw")
def keep_columns(spark, sf):
    raw = raw_jobs(spark, sf)
    return raw.select([n for n in fv.KEEP_COLUMNS if n in raw.columns])


@query(
    "p11_align_columns",
    RAW + " SELECT status, CAST(NULL AS DOUBLE) AS scaffold_height, CAST(budget_revenue AS DOUBLE) AS budget_revenue FROM raw",
)
def align_columns(spark, sf):
    return optional.align_columns(
        raw_jobs(spark, sf), {"status": "string", "scaffold_height": "double", "budget_revenue": "double"}
    )


@query(
    "p12_resolve_target",
    RAW + " SELECT 'budget_revenue' AS target, count(DISTINCT budget_revenue) AS distinct_values FROM raw",
)
def resolve_target(spark, sf):
    raw = raw_jobs(spark, sf)
    target = naming.resolve_target(raw, " Budget-Revenue ")
    values = raw.groupBy(target).count()
    return values.agg(F.lit(target).alias("target"), F.count(target).alias("distinct_values"))


@query(
    "p13_regression_rows",
    RAW + """ SELECT project_no, CAST(regexp_replace(raw_price_text, '£', '') AS DOUBLE) AS target
      FROM raw WHERE starts_with(raw_price_text, '£')""",
)
def regression_rows(spark, sf):
    priced = raw_jobs(spark, sf).select("project_no", F.translate("raw_price_text", "£", "").alias("target"))
    return features.usable_target(priced, "target", "regression")


_MESSY = """ SELECT o_orderkey AS order_no, o_custkey AS client_no, o_totalprice AS total_price,
    o_orderpriority AS priority FROM orders"""


def messy_orders(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias(" Order No"), F.col("o_custkey").alias("Client/No"),
        F.col("o_totalprice").alias("TOTAL-PRICE "), F.col("o_orderpriority").alias("priority"),
        F.col("o_orderstatus").alias("Total Price"),
    )


@query("s3_normalize_columns", _MESSY)
def normalize_columns(spark, sf):
    return naming.normalize_columns(messy_orders(spark, sf))


@query(
    "s4_snake_columns",
    " SELECT o_orderkey AS order_no, o_custkey AS client_no, o_totalprice AS total_price_gbp FROM orders",
)
def snake_columns(spark, sf):
    return naming.snake_columns(
        table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("__Order--No"), F.col("o_custkey").alias(" Client # No "),
            F.col("o_totalprice").alias("Total Price (GBP)"),
        )
    )


@query(
    "s1_read_delimited",
    """ SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderpriority || '; "quoted", ' || o_orderstatus AS note,
      CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders""",
)
def read_delimited(spark, sf):
    """The orders written as semicolon-separated text and read back with a guessed delimiter."""
    path = scratch_path(spark, "orders") + ".csv"
    table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("o_orderkey"),
        F.concat(F.col("o_orderpriority"), F.lit('; "quoted", '), F.col("o_orderstatus")).alias("note"),
        F.col("o_custkey").cast("string").alias("o_custkey"),
    ).write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return files.load_dataset(spark, path)


@query(
    "s5_write_dataset",
    RAW + " SELECT project_no, related_contacts, CAST(budget_revenue AS VARCHAR) AS budget_revenue, raw_price_text FROM raw",
)
def write_dataset(spark, sf):
    path = scratch_path(spark, "jobs") + ".tsv"
    files.write_dataset(
        raw_jobs(spark, sf).select("project_no", "related_contacts", "budget_revenue", "raw_price_text"), path
    )
    return files.load_dataset(spark, path)


@query("s8_staged_jobs", JOBS + " SELECT count(*) AS jobs, CAST(sum(len(teams)) AS BIGINT) AS team_mentions FROM jobs")
def staged_jobs(spark, sf):
    return jobs(spark, sf).agg(F.count(F.lit(1)).alias("jobs"), F.sum(F.size("teams")).alias("team_mentions"))
