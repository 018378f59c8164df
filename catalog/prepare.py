"""Preparation and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import RAW, query, raw_jobs, staged
from jobsight.operators import clean, prepare
from jobsight.plans import workflows
from jobsight.session import scratch_path

# --- prepare ---------------------------------------------------------------------------------

_SELECT = RAW + """, complete AS (
  SELECT *, trim(related_contacts) AS team, md5('42|' || project_no) AS ord,
         regexp_matches(lower(status), 'cancel|postponed|down|completed|complete|closed') OR c_hscategory IS NOT NULL
           OR c_hsincidentdate IS NOT NULL OR c_damagestatus IS NOT NULL OR c_damagecategory IS NOT NULL AS is_priority
  FROM raw WHERE trim(coalesce(related_contacts, '')) <> '' AND c_homeownerpostcode IS NOT NULL AND c_scaffoldpurpose IS NOT NULL
    AND status IS NOT NULL AND date IS NOT NULL AND due_date IS NOT NULL AND budget_revenue IS NOT NULL
), top AS (
  SELECT team, count(*) AS team_jobs FROM complete GROUP BY team ORDER BY team_jobs DESC, team LIMIT 250
), eligible AS (
  SELECT * FROM complete WHERE team IN (SELECT team FROM top)
), sampled AS (
  SELECT *, FALSE AS kept FROM eligible QUALIFY row_number() OVER (PARTITION BY team ORDER BY ord) <= 60
), prio AS (
  SELECT *, TRUE AS kept FROM eligible WHERE is_priority ORDER BY ord LIMIT 4000
), combined AS (
  SELECT * FROM prio UNION ALL SELECT * FROM sampled WHERE project_no NOT IN (SELECT project_no FROM prio)
), chosen AS (
  SELECT * FROM combined ORDER BY kept DESC, ord LIMIT 12000
), aliases AS (
  SELECT contact_name, 'Client ' || lpad(CAST(row_number() OVER (ORDER BY count(*) DESC, contact_name) AS VARCHAR), 4, '0') AS alias
  FROM chosen GROUP BY contact_name
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY team, date, project_no) AS job_number FROM chosen
), safe AS (
  SELECT 'JOB-' || lpad(CAST(job_number AS VARCHAR), 6, '0') AS project_no,
         'Project ' || lpad(CAST(job_number AS VARCHAR), 6, '0') AS project_name, alias AS contact_name,
         date, due_date, completed_date, status,
         CASE WHEN regexp_matches(lower(status), 'cancel|postponed') THEN 'cancelled'
              WHEN regexp_matches(lower(status), 'down|completed|complete|closed|handed over') THEN 'completed'
              WHEN regexp_matches(lower(status), 'booked|planned|awaiting|rts|request|sent') THEN 'active' ELSE 'other' END AS status_group,
         CAST(NULL AS DOUBLE) AS total_to_do, CAST(budget_revenue AS DOUBLE) AS budget_revenue,
         CAST(actual_revenue AS DOUBLE) AS actual_revenue, CAST(budget_cost AS DOUBLE) AS budget_cost,
         CAST(actual_cost AS DOUBLE) AS actual_cost, team AS related_contacts,
         split_part(c_homeownerpostcode, ' ', 1) AS c_homeownerpostcode, c_locationofscaffold, c_scaffoldpurpose,
         CAST(try_strptime(c_hsincidentdate, '%d/%m/%Y') AS DATE) AS c_hsincidentdate, c_hscategory,
         CAST(c_riddorreportable AS DOUBLE) AS c_riddorreportable, c_damagestatus, c_damagecategory
  FROM numbered JOIN aliases USING (contact_name)
)"""


def eligible(spark, sf):
    return prepare.of_top_teams(prepare.complete_rows(raw_jobs(spark, sf)), 250)


def chosen(spark, sf):
    return staged(spark, sf, "selected_rows", lambda: prepare.select_rows(raw_jobs(spark, sf)))


def safe(spark, sf):
    return prepare.privacy_reduced(chosen(spark, sf))


@query("p2_complete_rows", _SELECT + " SELECT project_no FROM complete")
def complete_rows(spark, sf):
    return prepare.complete_rows(raw_jobs(spark, sf)).select("project_no")


@query("t2_top_teams", _SELECT + " SELECT team, team_jobs FROM top")
def top_teams(spark, sf):
    return prepare.top_teams(prepare.complete_rows(raw_jobs(spark, sf)), 250).withColumnRenamed("_team", "team")


@query("j1_top_team_rows", _SELECT + " SELECT project_no, team FROM eligible")
def top_team_rows(spark, sf):
    return eligible(spark, sf).select("project_no", F.col("_team").alias("team"))


@query("p8_priority_rows", _SELECT + " SELECT project_no, is_priority FROM complete")
def priority_rows(spark, sf):
    rows = prepare.complete_rows(raw_jobs(spark, sf))
    return rows.select("project_no", prepare.is_priority(rows).alias("is_priority"))


def marked(spark, sf):
    rows = raw_jobs(spark, sf).withColumn("_team", F.col("contact_name"))
    return rows.withColumn("_priority", prepare.is_priority(rows)).withColumn(
        "_order", prepare.mix_order(42, "project_no")
    )


@query(
    "w3_sample_per_client",
    RAW + """ SELECT project_no, contact_name FROM raw
      QUALIFY row_number() OVER (PARTITION BY contact_name ORDER BY md5('42|' || project_no)) <= 5""",
)
def sample_per_client(spark, sf):
    return prepare.sample_per_team(marked(spark, sf), 5).select("project_no", "contact_name")


@query(
    "u1_selected_rows",
    _SELECT + " SELECT project_no, related_contacts, date FROM chosen",
)
def selected_rows(spark, sf):
    return prepare.select_rows(raw_jobs(spark, sf)).select("project_no", "related_contacts", "date")


# A small policy over the clients as teams makes the target limit bind on the whole table.
_TIGHT = RAW + """, marked AS (
  SELECT *, md5('42|' || project_no) AS ord,
         regexp_matches(lower(status), 'cancel|postponed|down|completed|complete|closed') OR c_hscategory IS NOT NULL
           OR c_hsincidentdate IS NOT NULL OR c_damagestatus IS NOT NULL OR c_damagecategory IS NOT NULL AS is_priority
  FROM raw WHERE related_contacts IS NOT NULL
), top AS (SELECT contact_name FROM marked GROUP BY 1 ORDER BY count(*) DESC, contact_name LIMIT 100
), eligible AS (SELECT * FROM marked WHERE contact_name IN (SELECT contact_name FROM top)
), prio AS (SELECT project_no FROM eligible WHERE is_priority ORDER BY ord LIMIT 100
), sampled AS (
  SELECT project_no FROM eligible QUALIFY row_number() OVER (PARTITION BY contact_name ORDER BY ord) <= 5
), united AS (SELECT project_no FROM prio UNION SELECT project_no FROM sampled
), chosen AS (
  SELECT project_no, project_no IN (SELECT project_no FROM prio) AS kept FROM united
  ORDER BY kept DESC, md5('42|' || project_no) LIMIT 300
)"""


def tight_rows(spark, sf):
    by_client = raw_jobs(spark, sf).where("related_contacts is not null").withColumn(
        "related_contacts", F.col("contact_name")
    )
    policy = prepare.Policy(target_rows=300, top_teams=100, rows_per_team=5)
    return prepare.select_rows(by_client, policy)


@query("j7_remainder_fill", _TIGHT + " SELECT project_no FROM chosen")
def remainder_fill(spark, sf):
    return tight_rows(spark, sf).select("project_no")


@query("u2_kept_priority_rows", _TIGHT + " SELECT project_no FROM chosen WHERE kept")
def kept_priority(spark, sf):
    by_client = raw_jobs(spark, sf).where("related_contacts is not null").withColumn(
        "related_contacts", F.col("contact_name")
    )
    rows = prepare.of_top_teams(prepare.complete_rows(by_client), 100)
    marked = rows.withColumn("_priority", prepare.is_priority(rows)).withColumn(
        "_order", prepare.mix_order(42, "project_no")
    )
    prio = prepare.sample_priority(marked, 100).select("project_no")
    return tight_rows(spark, sf).join(prio, "project_no", "left_semi").select("project_no")


@query("u3_remainder", _TIGHT + " SELECT project_no FROM chosen WHERE NOT kept")
def remainder(spark, sf):
    return tight_rows(spark, sf).join(kept_priority(spark, sf), "project_no", "left_anti").select("project_no")


@query("j2_client_aliases", _SELECT + " SELECT contact_name, alias FROM aliases")
def client_aliases(spark, sf):
    return prepare.client_aliases(chosen(spark, sf))


@query(
    "w4_job_numbers",
    RAW + """ SELECT project_no, row_number() OVER (ORDER BY contact_name, date, project_no) AS job_number FROM raw""",
)
def job_numbers(spark, sf):
    rows = raw_jobs(spark, sf).withColumn("_team", F.col("contact_name"))
    return prepare.number_jobs(rows, ["project_no"]).select("project_no", "job_number")


@query("s0_safe_dataset", _SELECT + " SELECT * FROM safe")
def safe_dataset(spark, sf):
    return safe(spark, sf)


@query("t1_output_order", _SELECT + " SELECT related_contacts, date, project_no FROM safe ORDER BY 1, 2, 3")
def output_order(spark, sf):
    return prepare.in_output_order(safe(spark, sf)).select("related_contacts", "date", "project_no")


@query(
    "s6_manifest",
    _SELECT + """ SELECT (SELECT count(*) FROM raw) AS source_rows, 25 AS source_columns, (SELECT count(*) FROM safe) AS output_rows,
      22 AS output_columns, (SELECT count(*) FROM aliases) AS client_aliases, 250 AS top_teams, 60 AS max_rows_per_team,
      12000 AS target_rows, 'project_manager' AS dropped_columns, 21 AS kept_columns""",
)
def manifest(spark, sf):
    written = workflows.write_safe_dataset(raw_jobs(spark, sf), scratch_path(spark, "safe") + ".parquet")
    return written.withColumns({
        "dropped_columns": F.array_join("dropped_columns", ","), "kept_columns": F.size("kept_columns"),
    })


@query("s6_status_groups", _SELECT + " SELECT status_group, count(*) AS jobs FROM safe GROUP BY status_group")
def status_groups(spark, sf):
    return prepare.status_group_counts(safe(spark, sf))


# --- clean -----------------------------------------------------------------------------------

_MESSY = RAW + """, messy AS (
  SELECT related_contacts, status, raw_price_text, raw_date_text, c_homeownerpostcode,
         CASE WHEN c_damagestatus IS NOT NULL THEN 'y' WHEN c_hscategory IS NOT NULL THEN 'Partial' ELSE 'FALSE' END AS c_edgeprotection,
         CASE WHEN c_hscategory IS NULL THEN '0' ELSE '1.0' END AS has_incident,
         CAST(budget_revenue AS VARCHAR) AS budget_revenue, CAST(date AS VARCHAR) AS booked_on
  FROM raw
), typed AS (
  SELECT related_contacts, status, raw_price_text, replace(c_homeownerpostcode, ' ', '') AS c_homeownerpostcode,
         coalesce(try_strptime(raw_date_text, '%Y-%m-%d'), try_strptime(raw_date_text, '%d/%m/%Y')) AS raw_date_text,
         c_edgeprotection,
         CASE c_edgeprotection WHEN 'y' THEN 'Yes' WHEN 'FALSE' THEN 'No' ELSE c_edgeprotection END AS c_edgeprotection_normalized,
         has_incident <> '0' AS has_incident, CAST(budget_revenue AS DOUBLE) AS budget_revenue,
         CAST(booked_on AS TIMESTAMP) AS booked_on
  FROM messy
)"""

def messy(spark, sf):
    """A raw export: dirty names and texts, two empty columns, every row present twice."""
    rows = raw_jobs(spark, sf).select(
        F.col("related_contacts").alias("Related Contacts"),
        F.concat(F.lit(" "), F.col("status"), F.lit(" ")).alias("Status"),
        F.col("raw_price_text").alias("Raw Price (text)"),
        F.col("raw_date_text").alias("Raw/Date/Text"),
        F.col("c_homeownerpostcode").alias("C_HomeownerPostcode"),
        F.when(F.col("c_damagestatus").isNotNull(), "y").when(F.col("c_hscategory").isNotNull(), " Partial ")
        .otherwise(" FALSE").alias("C_EdgeProtection"),
        F.when(F.col("c_hscategory").isNull(), "0").otherwise("1.0").alias("Has Incident"),
        F.col("budget_revenue").cast("string").alias("Budget Revenue"),
        F.col("date").cast("string").alias("Booked On"),
        F.lit(None).cast("string").alias("Nothing"),
        F.lit("  nan ").alias("Only Blanks"),
    )
    return rows.unionByName(rows)


@query("a23_clean_table", _MESSY + " SELECT DISTINCT * FROM typed")
def clean_table(spark, sf):
    return clean.clean_table(messy(spark, sf))[0]


@query(
    "f3_f6_f12_column_decisions",
    _MESSY + """, n AS (SELECT 2 * count(*) AS rows, 2 * count(related_contacts) AS teams,
        2 * count(*) FILTER (WHERE raw_price_text <> 'n/a' AND raw_price_text NOT LIKE '(%') AS priced,
        2 * count(raw_date_text) AS dated FROM typed)
      SELECT 'related_contacts' AS "column", rows, teams AS filled, 0 AS dated, 0 AS numeric, 'text' AS decision FROM n
      UNION ALL SELECT 'status', rows, rows, 0, 0, 'text' FROM n
      UNION ALL SELECT 'raw_price_text', rows, rows, 0, priced, 'text' FROM n
      UNION ALL SELECT 'raw_date_text', rows, rows, dated, 0, 'date' FROM n
      UNION ALL SELECT 'c_homeownerpostcode', rows, rows, 0, 0, 'text' FROM n
      UNION ALL SELECT 'c_edgeprotection', rows, rows, 0, 0, 'text' FROM n
      UNION ALL SELECT 'has_incident', rows, rows, 0, rows, 'boolean' FROM n
      UNION ALL SELECT 'budget_revenue', rows, rows, 0, rows, 'number' FROM n
      UNION ALL SELECT 'booked_on', rows, rows, rows, 0, 'date' FROM n
      UNION ALL SELECT 'nothing', rows, 0, 0, 0, 'empty' FROM n
      UNION ALL SELECT 'only_blanks', rows, 0, 0, 0, 'empty' FROM n""",
)
def column_decisions(spark, sf):
    tests = clean.column_tests(clean.tidy_text(clean.snake_columns(messy(spark, sf))))
    return clean.decisions(tests).select("column", "rows", "filled", "dated", "numeric", "decision")


@query(
    "p9_drop_empty_columns",
    _MESSY + " SELECT count(*) AS rows, 10 AS columns FROM (SELECT DISTINCT * FROM typed)",
)
def drop_empty_columns(spark, sf):
    cleaned, _ = clean.clean_table(messy(spark, sf))
    return cleaned.agg(F.count(F.lit(1)).alias("rows"), F.lit(len(cleaned.columns)).alias("columns"))


@query(
    "s7_cleaning_log",
    _MESSY + """, counts AS (
      SELECT (SELECT 2 * count(*) FROM typed) AS rows_before, (SELECT count(*) FROM (SELECT DISTINCT * FROM typed)) AS rows_after)
      SELECT step, "column", NULL AS rows_before, NULL AS rows_after FROM (VALUES ('drop_empty', 'nothing'), ('drop_empty', 'only_blanks'),
        ('to_date', 'raw_date_text'), ('to_date', 'booked_on'), ('to_number', 'budget_revenue'),
        ('to_boolean', 'has_incident')) AS t(step, "column")
      UNION ALL SELECT 'drop_duplicates', NULL, rows_before, rows_after FROM counts""",
)
def cleaning_log(spark, sf):
    return workflows.write_cleaned(messy(spark, sf), scratch_path(spark, "cleaned") + ".parquet")
