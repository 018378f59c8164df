"""Registration of queries with their check SQL, and the shared pieces of both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobsight.operators import ingest
from jobsight.session import stage
from jobsight.sources import testdata

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name``; ``sql`` is its DuckDB equivalent, if there is one."""

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return testdata.table(spark, sf, name)


_STAGED: dict[tuple[str, str, str], DataFrame] = {}


def staged(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table written once per application and read by every query that needs it."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGED:
        _STAGED[key] = stage(build(), name)
    return _STAGED[key]


def planned(spark: SparkSession, sf: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A frame built once per application and run by every query that needs it, for results too large to write."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _STAGED:
        _STAGED[key] = build()
    return _STAGED[key]


def raw_jobs(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "raw_jobs", lambda: testdata.raw_jobs(spark, sf))


def jobs(spark: SparkSession, sf: str) -> DataFrame:
    return staged(spark, sf, "jobs", lambda: ingest.canonical_jobs(raw_jobs(spark, sf)))


def all_intake(spark: SparkSession, sf: str) -> DataFrame:
    """Every job of the table as an intake row."""
    return staged(spark, sf, "all_intake", lambda: ingest.canonical_intake(testdata.as_intake(raw_jobs(spark, sf))))


def rounded(expression: str, digits: int) -> str:
    """Round half up on the shortest decimal form of a double, as Spark's ``round`` does."""
    return f"CAST(round(CAST(CAST({expression} AS VARCHAR) AS DECIMAL(38,14)), {digits}) AS DOUBLE)"


RAW = """
WITH li AS (
  SELECT l_orderkey,
         string_agg(DISTINCT s_name, '|' ORDER BY s_name) AS teams,
         CAST(min(l_shipdate) AS DATE) AS first_ship,
         CAST(max(l_shipdate) AS DATE) AS last_ship,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS line_revenue,
         CAST(sum(CAST(l_quantity AS DECIMAL(18,2)) * 10) AS DECIMAL(18,2)) AS line_cost,
         CAST(sum(l_quantity) AS INT) AS qty,
         min(p_type) AS first_type,
         bool_or(l_returnflag = 'R' AND l_quantity >= 45) AS near_miss,
         min(CASE WHEN l_returnflag = 'R' AND l_quantity >= 48 THEN l_shipdate END) AS incident,
         count(*) FILTER (WHERE l_tax >= 0.08 AND l_quantity >= 49) AS riddor,
         bool_or(l_returnflag = 'R' AND l_discount >= 0.1) AS damaged,
         bool_or(l_returnflag = 'A' AND l_discount >= 0.1 AND l_quantity >= 40) AS roof_tile
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey
  GROUP BY l_orderkey
), raw AS (
  SELECT 'JOB-' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS project_no,
         'Project ' || lpad(CAST(o_orderkey AS VARCHAR), 6, '0') AS project_name,
         c_name AS contact_name,
         'PM-' || CAST(o_custkey % 12 AS VARCHAR) AS project_manager,
         teams AS related_contacts,
         CAST(o_orderdate AS DATE) AS date,
         first_ship AS due_date,
         last_ship AS completed_date,
         CASE WHEN o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' THEN 'Handed Over'
              WHEN o_orderstatus = 'F' THEN 'Scaffold Down'
              WHEN o_orderstatus = 'O' AND o_orderpriority = '5-LOW' THEN 'Postponed'
              WHEN o_orderstatus = 'O' THEN 'Booked'
              WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Cancelled by client'
              WHEN o_orderpriority = '3-MEDIUM' THEN 'On hold'
              ELSE 'Awaiting materials' END AS status,
         o_orderpriority AS budget_type,
         CAST(o_totalprice AS DECIMAL(18,2)) AS budget_revenue,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(0.8 AS DECIMAL(2,1)) AS DECIMAL(18,2)) AS budget_cost,
         line_revenue AS actual_revenue,
         line_cost AS actual_cost,
         CAST(qty // 60 AS VARCHAR) || ':' || lpad(CAST(qty % 60 AS VARCHAR), 2, '0') || ':00' AS total_to_do,
         'N' || CAST(c_nationkey AS VARCHAR) || ' ' || CAST(o_orderkey % 9 AS VARCHAR) || 'AA' AS c_homeownerpostcode,
         first_type AS c_scaffoldpurpose,
         n_name AS c_locationofscaffold,
         CASE WHEN near_miss THEN 'Near miss' END AS c_hscategory,
         strftime(incident, '%d/%m/%Y') AS c_hsincidentdate,
         riddor AS c_riddorreportable,
         CASE WHEN damaged THEN 'Open' END AS c_damagestatus,
         CASE WHEN roof_tile THEN 'Roof tile' END AS c_damagecategory,
         CASE WHEN o_orderkey % 7 = 0 THEN '(' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) || ')'
              WHEN o_orderkey % 11 = 0 THEN 'n/a'
              ELSE '£' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) END AS raw_price_text,
         CASE WHEN o_orderkey % 13 = 0 THEN '0000-00-00'
              WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS raw_date_text
  FROM orders JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey
       LEFT JOIN li ON o_orderkey = l_orderkey
)"""

JOBS = RAW + """, jobs AS (
  SELECT project_no, project_name, contact_name AS client, lower(contact_name) AS client_key,
         CASE WHEN related_contacts IS NULL THEN CAST([] AS VARCHAR[])
              ELSE list_filter(list_transform(string_split(related_contacts, '|'), lambda x: trim(x)),
                               lambda x: x <> '') END AS teams,
         status,
         regexp_matches(lower(status), 'booked|planned|awaiting|rts|request|sent')
           AND NOT regexp_matches(lower(status), 'cancel|postponed') AS is_active,
         regexp_matches(lower(status), 'cancel|postponed') AS is_cancelled,
         regexp_matches(lower(status), 'down|completed|complete|closed|handed over')
           AND NOT regexp_matches(lower(status), 'cancel|postponed') AS is_completed,
         regexp_matches(lower(status), 'down|completed|complete|closed|handed over') AS says_completed,
         date AS start_at, due_date AS due_at, completed_date AS completed_at,
         completed_date - date AS cycle_days,
         CAST(budget_revenue AS DOUBLE) AS budget_revenue,
         budget_revenue AS budget_revenue_d, actual_revenue AS actual_revenue_d,
         budget_cost AS budget_cost_d, actual_cost AS actual_cost_d,
         CAST(split_part(total_to_do, ':', 1) AS DOUBLE)
           + CAST(split_part(total_to_do, ':', 2) AS DOUBLE) / 60 AS to_do_hours,
         budget_type, c_homeownerpostcode AS postcode,
         split_part(c_homeownerpostcode, ' ', 1) AS area,
         lower(c_scaffoldpurpose) AS job_type_key,
         c_hscategory IS NOT NULL AS hse_category,
         try_strptime(c_hsincidentdate, '%d/%m/%Y') IS NOT NULL AS hse_dated,
         coalesce(c_riddorreportable > 0, FALSE) AS riddor,
         c_hscategory IS NOT NULL OR c_hsincidentdate IS NOT NULL OR coalesce(c_riddorreportable > 0, FALSE) AS hse_event,
         c_damagestatus IS NOT NULL AS damage_status,
         c_damagecategory IS NOT NULL AS damage_category,
         c_damagestatus IS NOT NULL OR c_damagecategory IS NOT NULL AS damage_event
  FROM raw
), hist AS (
  SELECT jobs.*, team_key
  FROM jobs, (SELECT project_no AS pn, unnest(list_distinct(list_transform(teams, lambda x: lower(x)))) AS team_key
              FROM jobs) t
  WHERE jobs.project_no = t.pn
), spellings AS (
  SELECT lower(name) AS team_key, name, count(*) AS times
  FROM (SELECT unnest(teams) AS name FROM jobs) GROUP BY ALL
), names AS (
  SELECT team_key, first(name ORDER BY times DESC, name) AS team, CAST(sum(times) AS BIGINT) AS frequency
  FROM spellings GROUP BY team_key
), stats AS (
  SELECT team_key, count(*) AS total_jobs,
         count(*) FILTER (WHERE is_completed) AS completed_jobs,
         count(*) FILTER (WHERE is_cancelled) AS cancelled_jobs,
         count(*) FILTER (WHERE says_completed) AS says_completed_jobs,
         count(*) FILTER (WHERE hse_event) AS hse_jobs,
         count(*) FILTER (WHERE damage_event) AS damage_jobs,
         greatest(count(*) FILTER (WHERE hse_category), count(*) FILTER (WHERE hse_dated))
           + count(*) FILTER (WHERE riddor) AS hse_signals,
         greatest(count(*) FILTER (WHERE damage_status), count(*) FILTER (WHERE damage_category)) AS damage_signals,
         sum(budget_revenue_d) AS price_total, count(budget_revenue) AS priced_jobs,
         median(budget_revenue) AS median_price
  FROM hist GROUP BY team_key
)"""

_INTAKE = """
  SELECT project_no AS job_id, split_part(related_contacts, '|', 1) AS partner,
         lower(split_part(related_contacts, '|', 1)) AS team_key, contact_name AS client,
         c_scaffoldpurpose AS job_type, lower(c_scaffoldpurpose) AS job_type_key,
         c_homeownerpostcode AS postcode, split_part(c_homeownerpostcode, ' ', 1) AS area,
         due_date - date AS lead_days, CAST(budget_revenue AS DOUBLE) AS price,
         CAST(actual_cost AS DOUBLE) AS cost, date AS start_on, due_date AS due_on
"""

ALL_INTAKE = JOBS + f""", intake AS ({_INTAKE} FROM raw)"""
