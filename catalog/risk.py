"""Risk score, decision and assessment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ALL_INTAKE, all_intake, jobs, query, raw_jobs, rounded, staged
from catalog.teams import RANKED, shown
from jobsight import fixed_values as fv
from jobsight.functions import numbers
from jobsight.operators import decisions, history, ingest, leaderboard, risk
from jobsight.session import stage
from jobsight.sources import testdata

# Brute force on purpose: each intake job is joined with all jobs of its team.
_SIMILAR = """, j AS (
  SELECT i.*, s.* EXCLUDE (team_key) FROM intake i JOIN stats s USING (team_key)
), flags AS (
  SELECT j.job_id, h.says_completed, h.is_cancelled,
         coalesce(h.job_type_key = j.job_type_key, FALSE) AS m1, coalesce(h.area = j.area, FALSE) AS m2,
         coalesce(h.budget_revenue BETWEEN j.price * 0.75 AND j.price * 1.25, FALSE) AS m3
  FROM j JOIN hist h ON h.team_key = j.team_key
), step1 AS (
  SELECT *, count(*) FILTER (WHERE m1) OVER (PARTITION BY job_id) >= 10 AS g1 FROM flags
), set1 AS (
  SELECT * FROM step1 WHERE NOT g1 OR m1
), step2 AS (
  SELECT *, count(*) FILTER (WHERE m2) OVER (PARTITION BY job_id) >= 10 AS g2 FROM set1
), set2 AS (
  SELECT * FROM step2 WHERE NOT g2 OR m2
), step3 AS (
  SELECT *, count(*) FILTER (WHERE m3) OVER (PARTITION BY job_id) >= 10 AS g3 FROM set2
), sim AS MATERIALIZED (
  SELECT job_id, count(*) AS similar_n, count(*) FILTER (WHERE says_completed) AS similar_completed,
         count(*) FILTER (WHERE is_cancelled) AS similar_cancelled
  FROM step3 WHERE NOT g3 OR m3 GROUP BY job_id
), g AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE says_completed) AS completed,
         count(*) FILTER (WHERE is_cancelled) AS cancelled,
         greatest(count(*) FILTER (WHERE hse_category), count(*) FILTER (WHERE hse_dated))
           + count(*) FILTER (WHERE riddor) AS hse_signals,
         greatest(count(*) FILTER (WHERE damage_status), count(*) FILTER (WHERE damage_category)) AS damage_signals
  FROM jobs
), rates AS (
  SELECT j.*, sim.* EXCLUDE (job_id),
         (similar_completed + says_completed_jobs + g.completed) / (similar_n + total_jobs + g.n) AS completion_rate,
         (similar_cancelled + cancelled_jobs + g.cancelled) / (similar_n + total_jobs + g.n) AS cancellation_rate,
         (j.hse_signals + g.hse_signals) / (total_jobs + g.n) AS hse_rate,
         (j.damage_signals + g.damage_signals) / (total_jobs + g.n) AS damage_rate,
         CASE WHEN lead_days < 0 THEN 0.35::DOUBLE WHEN lead_days <= 2 THEN 0.18::DOUBLE
              WHEN lead_days <= 5 THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END AS lead
  FROM j JOIN sim USING (job_id), g
), parts AS (
  SELECT *,
    round(least(100, greatest(0, (hse_rate
      + CASE WHEN regexp_matches(coalesce(job_type_key, ''), 'roof|chimney|edge|gable|height|flue|render|brickwork')
             THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END + lead / 3) * 100)), 1) AS hse_pct,
    round(least(100, greatest(0, (damage_rate
      + CASE WHEN contains(coalesce(job_type_key, ''), 'roof') THEN 0.04::DOUBLE ELSE 0.0::DOUBLE END) * 100)), 1) AS damage_pct,
    round(least(100, greatest(0, (completion_rate - least(0.25::DOUBLE, lead)) * 100)), 1) AS completion_pct,
    round(least(100, greatest(0, (cancellation_rate + least(0.22::DOUBLE, lead)) * 100)), 1) AS cancellation_pct,
    round(least(100, greatest(0, (
      CASE WHEN price < median_price * 0.75::DOUBLE THEN 0.22::DOUBLE WHEN price < median_price * 0.9::DOUBLE THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END
      + CASE WHEN price > 0 AND (price - cost) / price < 0 THEN 0.45::DOUBLE
             WHEN price > 0 AND (price - cost) / price < 0.15::DOUBLE THEN 0.25::DOUBLE
             WHEN price > 0 AND (price - cost) / price < 0.25::DOUBLE THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END) * 100)), 1) AS margin_pct,
    round(least(100, greatest(0, (cancellation_rate + lead
      + CASE WHEN total_jobs >= 500 AND says_completed_jobs / total_jobs < 0.8::DOUBLE THEN 0.08::DOUBLE ELSE 0.0::DOUBLE END) * 100)), 1) AS programme_pct
  FROM rates
), scored AS MATERIALIZED (
  SELECT *, round(greatest(100.0::DOUBLE - completion_pct, cancellation_pct, programme_pct * 0.85::DOUBLE), 1) AS failure_pct
  FROM parts
), signals AS (
  SELECT job_id, 0 AS ord, 'Failure / non-completion risk' AS name, failure_pct AS score_pct,
         CASE WHEN failure_pct >= 25 THEN 'High' WHEN failure_pct >= 12 THEN 'Medium' ELSE 'Low' END AS level,
         'Combined risk that the job does not complete cleanly, using completion, cancellation and programme signals.' AS detail FROM scored
  UNION ALL SELECT job_id, 1, 'HSE / incident risk', hse_pct,
         CASE WHEN hse_pct >= 8 THEN 'High' WHEN hse_pct >= 3 THEN 'Medium' ELSE 'Low' END,
         'Based on scaffolder incident history, RIDDOR flags, job type and short-notice pressure.' FROM scored
  UNION ALL SELECT job_id, 2, 'Completion likelihood', completion_pct,
         CASE WHEN completion_pct >= 82 THEN 'Strong' WHEN completion_pct >= 65 THEN 'Watch' ELSE 'Weak' END,
         'Likelihood the job follows the historic completed/scaffold-down pattern for this scaffolder and similar jobs.' FROM scored
  UNION ALL SELECT job_id, 3, 'Cancellation / postponement risk', cancellation_pct,
         CASE WHEN cancellation_pct >= 18 THEN 'High' WHEN cancellation_pct >= 8 THEN 'Medium' ELSE 'Low' END,
         'Uses the scaffolder''s historical cancellation/postponement pattern, adjusted for lead time.' FROM scored
  UNION ALL SELECT job_id, 4, 'Programme risk', programme_pct,
         CASE WHEN programme_pct >= 22 THEN 'High' WHEN programme_pct >= 10 THEN 'Medium' ELSE 'Low' END,
         'Highlights risk from short lead times, historic non-completion and cancellation patterns.' FROM scored
  UNION ALL SELECT job_id, 5, 'Damage / claim risk', damage_pct,
         CASE WHEN damage_pct >= 5 THEN 'High' WHEN damage_pct >= 2 THEN 'Medium' ELSE 'Low' END,
         'Based on historic damage status, category and description records for this scaffolder.' FROM scored
  UNION ALL SELECT job_id, 6, 'Price / margin pressure', margin_pct,
         CASE WHEN margin_pct >= 35 THEN 'High' WHEN margin_pct >= 15 THEN 'Medium' ELSE 'Low' END,
         'Compares input price/cost against historic scaffolder job values and implied margin.' FROM scored
), weighed AS (
  SELECT *, CASE WHEN level IN ('High', 'Weak') THEN 3 WHEN level IN ('Medium', 'Watch') THEN 2 ELSE 1 END AS severity
  FROM signals WHERE name <> 'Completion likelihood'
), decided AS (
  SELECT job_id, count(*) FILTER (WHERE severity = 3) AS high_signals, count(*) FILTER (WHERE severity = 2) AS watch_signals,
         first(name ORDER BY severity DESC, score_pct DESC, ord) AS top
  FROM weighed GROUP BY job_id
), advice AS (
  SELECT job_id, list_filter([
      CASE WHEN hse_pct >= 3 THEN 'Request RAMS early and check handover/photo evidence before install.' END,
      CASE WHEN programme_pct >= 10 THEN 'Confirm scaffolder availability and homeowner access before committing dates.' END,
      CASE WHEN cancellation_pct >= 8 THEN 'Keep a backup scaffolder option live until booking is confirmed.' END,
      CASE WHEN margin_pct >= 15 THEN 'Review price/cost before issue; this job may carry margin pressure.' END],
      lambda x: x IS NOT NULL) AS texts
  FROM scored
), advised AS (
  SELECT job_id, CASE WHEN len(texts) = 0 THEN ['Proceed with standard booking controls and normal handover checks.']
                      ELSE texts END AS texts FROM advice
)"""

SCORED = ALL_INTAKE + _SIMILAR
SCORE_COLUMNS = ["failure_pct", "hse_pct", "completion_pct", "cancellation_pct", "programme_pct", "damage_pct", "margin_pct"]

_DECISION = """
  CASE WHEN high_signals > 0 THEN 'Escalate before booking' WHEN watch_signals > 0 THEN 'Proceed with controls'
       ELSE 'Proceed standard' END"""

ASSESSED = RANKED.replace("), scored AS (", "), fitted AS (").replace("FROM scored", "FROM fitted") + _SIMILAR + f""", log AS (
  SELECT s.job_id AS id, s.start_on AS assessed_at, partner AS scaffolder, best_team, selected_rank, selected_fit_score AS fit_score,
         postcode, coalesce(job_type, 'N/A') AS job_type, price, failure_pct AS failure, completion_pct AS completion, hse_pct AS hse,
         programme_pct AS programme, margin_pct AS margin, {_DECISION} AS decision, texts[1] AS recommendation
  FROM scored s JOIN decided USING (job_id) JOIN advised USING (job_id) JOIN summary USING (job_id)
), kept_log AS (SELECT * FROM log ORDER BY assessed_at DESC, id DESC LIMIT 40)"""


def scored(spark, sf):
    return risk.risk_scores(all_intake(spark, sf), jobs(spark, sf))


@query("r1_risk_scores", SCORED + f" SELECT job_id, {', '.join(SCORE_COLUMNS)} FROM scored")
def risk_scores(spark, sf):
    return scored(spark, sf).select("job_id", *SCORE_COLUMNS)


@query("r1_risk_signals", SCORED + " SELECT job_id, name, score_pct, level, detail FROM signals")
def risk_signals(spark, sf):
    return risk.risk_signals(scored(spark, sf))


@query("r2_recommendations", SCORED + " SELECT job_id, unnest(texts) AS recommendation FROM advised")
def recommendations(spark, sf):
    return scored(spark, sf).select("job_id", F.explode(risk.recommendations()).alias("recommendation"))


@query(
    "r3_evidence",
    SCORED + f""" SELECT job_id, total_jobs AS scaffolder_jobs, similar_n AS similar_jobs_used, hse_signals AS hse_events,
      damage_signals AS damage_events, round(CAST(price_total AS DOUBLE) / priced_jobs, 2) AS avg_scaffolder_price,
      {rounded('median_price', 2)} AS median_scaffolder_price,
      round(least(100, greatest(0, says_completed_jobs / total_jobs * 100)), 1) AS completion_rate_pct,
      round(least(100, greatest(0, cancelled_jobs / total_jobs * 100)), 1) AS cancellation_rate_pct FROM scored""",
)
def evidence(spark, sf):
    return risk.evidence(scored(spark, sf))


@query(
    "j4_similar_history",
    SCORED + " SELECT job_id, team_key, total_jobs, similar_n, similar_completed, similar_cancelled FROM scored",
)
def similar_history(spark, sf):
    return risk.with_similar_history(all_intake(spark, sf), jobs(spark, sf)).select(
        "job_id", "team_key", "total_jobs", "similar_n", "similar_completed", "similar_cancelled"
    )


@query(
    "j5_price_band",
    ALL_INTAKE + """ SELECT i.job_id, count(*) AS n, count(*) FILTER (WHERE h.says_completed) AS completed,
      count(*) FILTER (WHERE h.is_cancelled) AS cancelled
      FROM intake i JOIN hist h USING (team_key)
      WHERE h.budget_revenue BETWEEN i.price * 0.75 AND i.price * 1.25 GROUP BY i.job_id""",
)
def price_band(spark, sf):
    table = jobs(spark, sf)
    sizes = history.team_history(table).groupBy("team_key").agg(F.count(F.lit(1)).alias("scope_rows"))
    probes = all_intake(spark, sf).join(sizes, "team_key").select(
        "job_id", "team_key", "price", F.lit("team").alias("level"), F.lit("").alias("scope_type"),
        F.lit("").alias("scope_area"), "scope_rows",
    )
    return history.price_band_counts(table, stage(probes, "price_probes"), ["job_id"])


@query(
    "a15_blended_rates",
    SCORED + """ SELECT job_id, round(completion_rate, 10) AS completion_rate, round(cancellation_rate, 10) AS cancellation_rate,
      round(hse_rate, 10) AS hse_rate, round(damage_rate, 10) AS damage_rate FROM rates""",
)
def blended_rates(spark, sf):
    return risk.blended_rates(all_intake(spark, sf), jobs(spark, sf)).select(
        "job_id", *[F.round(c, 10).alias(c) for c in ("completion_rate", "cancellation_rate", "hse_rate", "damage_rate")]
    )


@query(
    "r6_decisions",
    SCORED + f""" SELECT job_id, high_signals, watch_signals, {_DECISION} AS decision,
      CASE WHEN high_signals + watch_signals > 0 THEN top ELSE 'Normal handover controls' END AS priority,
      CASE WHEN high_signals > 0 THEN high_signals || ' high-priority signal' || CASE WHEN high_signals = 1 THEN '' ELSE 's' END || ' detected.'
           WHEN watch_signals > 0 THEN watch_signals || ' watch signal' || CASE WHEN watch_signals = 1 THEN '' ELSE 's' END || ' detected.'
           ELSE 'No elevated operational signal detected.' END AS rationale
      FROM decided""",
)
def decision_rows(spark, sf):
    return decisions.with_decision(scored(spark, sf)).select(
        "job_id", "high_signals", "watch_signals", "decision", "priority", "rationale"
    )


@query("t7_top_signal", SCORED + " SELECT top AS top_signal, count(*) AS jobs FROM decided GROUP BY ALL")
def top_signal(spark, sf):
    decided = decisions.with_decision(scored(spark, sf)).where("high_signals + watch_signals > 0")
    return decided.groupBy(F.col("priority").alias("top_signal")).agg(F.count(F.lit(1)).alias("jobs"))


@query(
    "f20_lead_time",
    ALL_INTAKE + " SELECT job_id, lead_days FROM intake",
)
def lead_time(spark, sf):
    return all_intake(spark, sf).select("job_id", "lead_days")


@query(
    "f21_f22_intake_fields",
    ALL_INTAKE + " SELECT job_id, partner, job_type, postcode, area, price, cost FROM intake",
)
def intake_fields(spark, sf):
    renamed = testdata.as_intake(raw_jobs(spark, sf)).select(
        "job_id", "related_contacts", F.lit(" ").alias("c_scaffoldpurpose"),
        F.col("c_scaffoldpurpose").alias("scaffold_purpose"), F.col("c_homeownerpostcode").alias("postcode"),
        F.lit("n/a").alias("budget_revenue"), F.concat(F.lit("£"), "budget_revenue").alias("quoted_price"),
        "budget_cost",
    )
    return ingest.canonical_intake(renamed).select("job_id", "partner", "job_type", "postcode", "area", "price", "cost")


@query(
    "f26_commercial_view",
    SCORED + f""" SELECT job_id, round(price - cost, 2) AS gross_margin,
      round(CASE WHEN price <> 0 THEN (price - cost) / price * 100 END, 2) AS gross_margin_pct,
      round(price - coalesce({rounded('median_price', 2)}, 0), 2) AS price_vs_median FROM scored""",
)
def commercial_view(spark, sf):
    return risk.commercial_view(scored(spark, sf))


@query(
    "f27_intake_readiness",
    ALL_INTAKE + """, missing AS (
      SELECT job_id, list_filter([CASE WHEN partner IS NULL THEN 'Scaffolder' END, CASE WHEN postcode IS NULL THEN 'Postcode' END,
        CASE WHEN job_type IS NULL THEN 'Job type' END, CASE WHEN start_on IS NULL THEN 'Erect date' END,
        CASE WHEN due_on IS NULL THEN 'Install / due date' END, CASE WHEN price IS NULL THEN 'Job price' END],
        lambda x: x IS NOT NULL) AS labels FROM intake)
      SELECT job_id, 6 - len(labels) AS present, CAST(round((6 - len(labels)) * 100 / 6) AS BIGINT) AS ready_pct,
             coalesce(array_to_string(labels, ', '), '') AS missing, len(labels) = 0 AS is_ready FROM missing""",
)
def readiness(spark, sf):
    return ingest.intake_readiness(testdata.as_intake(raw_jobs(spark, sf)))


@query(
    "j4_intake_errors",
    ALL_INTAKE + """ SELECT job_id, CASE WHEN team_key IS NULL
        THEN 'A scaffold partner company is required for scaffolder-focused predictions.'
        ELSE 'No historical jobs found for scaffolder ''' || partner || '''.' END AS error
      FROM intake WHERE team_key IS NULL OR team_key NOT IN (SELECT team_key FROM stats)""",
)
def intake_errors(spark, sf):
    return risk.intake_errors(all_intake(spark, sf), jobs(spark, sf))


def assessment_log(spark, sf):
    def build():
        start = raw_jobs(spark, sf).select(F.col("project_no").alias("job_id"), F.col("date").alias("start_on"))
        summary = leaderboard.summary(shown(spark, sf))
        return decisions.assessments(scored(spark, sf).join(start, "job_id"), summary, at=F.col("start_on"))

    return staged(spark, sf, "assessments", build)


@query("r7_assessments", ASSESSED + " SELECT * FROM log")
def assessment_rows(spark, sf):
    return assessment_log(spark, sf)


@query("w6_recent_assessments", ASSESSED + " SELECT * FROM kept_log")
def recent_assessments(spark, sf):
    return decisions.recent_assessments(assessment_log(spark, sf))


@query(
    "w6_shown_assessments",
    ASSESSED + """ SELECT id, assessed_at, scaffolder, decision, selected_rank, fit_score, failure, completion, programme,
      CAST(row_number() OVER (ORDER BY assessed_at DESC, id DESC) AS INT) AS position FROM kept_log QUALIFY position <= 8""",
)
def shown_assessments(spark, sf):
    return decisions.shown_assessments(assessment_log(spark, sf)).select(
        "id", "assessed_at", "scaffolder", "decision", "selected_rank", "fit_score", "failure", "completion", "programme", "position"
    )


@query(
    "a21_assessment_highlights",
    ASSESSED + """ SELECT count(*) AS runs, first(best_team ORDER BY assessed_at DESC, id DESC) AS latest_best_team,
      first(selected_rank ORDER BY assessed_at DESC, id DESC) AS latest_selected_rank,
      first(recommendation ORDER BY assessed_at DESC, id DESC) AS latest_recommendation,
      first(scaffolder ORDER BY failure DESC, assessed_at, id) AS highest_failure_scaffolder, max(failure) AS highest_failure,
      first(scaffolder ORDER BY completion, assessed_at, id) AS lowest_completion_scaffolder, min(completion) AS lowest_completion,
      first(scaffolder ORDER BY hse DESC, assessed_at, id) AS highest_hse_scaffolder, max(hse) AS highest_hse,
      round(avg(fit_score), 4) AS avg_fit, round(avg(failure), 4) AS avg_failure, round(avg(completion), 4) AS avg_completion
      FROM kept_log""",
)
def assessment_highlights(spark, sf):
    return decisions.assessment_highlights(assessment_log(spark, sf))
