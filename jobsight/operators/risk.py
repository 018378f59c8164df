"""Risk scores of intake jobs from the history of the selected team."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from jobsight import fixed_values as fv
from jobsight.functions.numbers import gross_margin, gross_margin_pct, pct, risk_level
from jobsight.functions.text import contains_any
from jobsight.session import stage
from jobsight.operators.history import (
    COUNTS,
    MEASURES,
    SCOPE,
    History,
    price_band_counts,
    signal_counts,
    team_statistics,
    with_narrowed_history,
)

SCORES = {
    "Failure / non-completion risk": "failure_pct",
    "HSE / incident risk": "hse_pct",
    "Completion likelihood": "completion_pct",
    "Cancellation / postponement risk": "cancellation_pct",
    "Programme risk": "programme_pct",
    "Damage / claim risk": "damage_pct",
    "Price / margin pressure": "margin_pct",
}


def intake_errors(intake: DataFrame, jobs: DataFrame | History) -> DataFrame:
    """Intake rows that cannot be scored, with the reason; all others are scored."""
    known = History.of(jobs).names.select("team_key").distinct()
    unnamed = intake.where(F.col("team_key").isNull()).select(
        "job_id",
        F.lit("A scaffold partner company is required for scaffolder-focused predictions.").alias("error"),
    )
    unknown = (
        intake.where(F.col("team_key").isNotNull())
        .join(known, "team_key", "left_anti")
        .select(
            "job_id",
            F.concat(F.lit("No historical jobs found for scaffolder '"), "partner", F.lit("'.")).alias("error"),
        )
    )
    return unnamed.unionByName(unknown)


def global_totals(jobs: DataFrame | History) -> DataFrame:
    """One row: the whole-table counts every blended rate mixes in."""
    totals = History.of(jobs).totals.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS])
    return totals.groupBy("n", "completed", "cancelled").agg(*signal_counts())


def with_similar_history(intake: DataFrame, jobs: DataFrame | History) -> DataFrame:
    """The selected team's statistics and its similar jobs for each intake job.

    The similar set narrows step by step: job type, then area, then price band, and each
    step applies only if it leaves at least ten rows of the current set.
    """
    gate, jobs = fv.RISK_GATE_ROWS, History.dealt(jobs)
    statistics = stage(team_statistics(jobs), "team_statistics")  # a row per team: written, so that its size is known
    whole = statistics.select("team_key", "total_jobs", "says_completed_jobs", "cancelled_jobs")
    # The search carries what it asks for; the other columns come back by row at the end.
    asked = intake.select("row_id", "team_key", "job_type_key", "area", "price").join(whole, "team_key")
    scoped = with_narrowed_history(asked, jobs, gate).select(
        "row_id", "team_key", "price", *SCOPE, "scope_rows", "scope_completed", "scope_cancelled"
    )
    scoped = stage(scoped, "asked_history")
    bands = price_band_counts(jobs, scoped.where(F.col("price").isNotNull()), ["row_id"]).select(
        "row_id", *[F.col(m).alias(f"band_{m}") for m in MEASURES]
    )

    def chosen(measure: str) -> Column:
        # The step that leaves too few rows is not taken.
        unpriced = F.col("scope_rows" if measure == "n" else f"scope_{measure}")
        return F.when(F.col("band_n") >= gate, F.col(f"band_{measure}")).otherwise(unpriced)

    similar = scoped.join(bands, "row_id", "left").select("row_id", *[chosen(m).alias(f"similar_{m}") for m in MEASURES])
    return intake.join(statistics, "team_key").join(similar, "row_id").select(
        *intake.columns,
        "total_jobs", "says_completed_jobs", "cancelled_jobs", "hse_signals", "damage_signals",
        "price_total", "priced_jobs", "median_price",
        *[f"similar_{m}" for m in MEASURES],
    )


def blended_rates(intake: DataFrame, jobs: DataFrame | History) -> DataFrame:
    """Rates over similar, team and whole-table rows together; events skip the similar set."""
    everything = global_totals(jobs).agg(
        F.first(F.struct("n", "completed", "cancelled", "hse_signals", "damage_signals"))
    ).scalar()
    at_least_one = lambda c: F.greatest(c, F.lit(1))
    team_rows, all_rows = at_least_one(F.col("total_jobs")), at_least_one(F.col("everything.n"))
    mixed_rows = at_least_one(F.col("similar_n")) + team_rows + all_rows
    own_rows = team_rows + all_rows
    return (
        with_similar_history(intake, jobs)
        .withColumn("everything", everything)
        .select(
            "*",
            (
                (F.col("similar_completed") + F.col("says_completed_jobs") + F.col("everything.completed"))
                / mixed_rows
            ).alias("completion_rate"),
            (
                (F.col("similar_cancelled") + F.col("cancelled_jobs") + F.col("everything.cancelled"))
                / mixed_rows
            ).alias("cancellation_rate"),
            ((F.col("hse_signals") + F.col("everything.hse_signals")) / own_rows).alias("hse_rate"),
            ((F.col("damage_signals") + F.col("everything.damage_signals")) / own_rows).alias("damage_rate"),
        )
        .drop("everything")
    )


def lead_penalty(days: Column) -> Column:
    """Short notice costs; an unknown lead time does not."""
    return (
        F.when(days < 0, 0.35).when(days <= 2, 0.18).when(days <= 5, 0.08).otherwise(F.lit(0.0))
    )


def _margin_risk() -> Column:
    price, cost, median = F.col("price"), F.col("cost"), F.col("median_price")
    against_median = F.when(
        median != 0, F.when(price < median * 0.75, 0.22).when(price < median * 0.9, 0.1)
    )
    margin = (price - cost) / price
    against_cost = F.when(
        price > 0, F.when(margin < 0, 0.45).when(margin < 0.15, 0.25).when(margin < 0.25, 0.1)
    )
    return F.coalesce(against_median, F.lit(0.0)) + F.coalesce(against_cost, F.lit(0.0))


def risk_scores(intake: DataFrame, jobs: DataFrame | History) -> DataFrame:
    """R1, wide: one row per intake job with its seven scores and the evidence behind them."""
    lead = lead_penalty(F.col("lead_days"))
    job_type = F.coalesce("job_type_key", F.lit(""))
    risky_type = F.when(contains_any(job_type, fv.HIGH_RISK_WORDS), 0.06).otherwise(F.lit(0.0))
    roof = F.when(F.contains(job_type, F.lit("roof")), 0.04).otherwise(F.lit(0.0))
    slow_team = F.when(
        (F.col("total_jobs") >= 500) & (F.col("says_completed_jobs") / F.col("total_jobs") < 0.8), 0.08
    ).otherwise(F.lit(0.0))
    scored = blended_rates(intake, jobs).select(
        "*",
        pct(F.col("hse_rate") + risky_type + lead / 3).alias("hse_pct"),
        pct(F.col("damage_rate") + roof).alias("damage_pct"),
        pct(F.col("completion_rate") - F.least(F.lit(0.25), lead)).alias("completion_pct"),
        pct(F.col("cancellation_rate") + F.least(F.lit(0.22), lead)).alias("cancellation_pct"),
        pct(_margin_risk()).alias("margin_pct"),
        pct(F.col("cancellation_rate") + lead + slow_team).alias("programme_pct"),
    )
    worst = F.greatest(
        100.0 - F.col("completion_pct"), F.col("cancellation_pct"), F.col("programme_pct") * 0.85
    )
    return scored.withColumn("failure_pct", F.round(worst, 1))


def _signal(name: str) -> Column:
    score = F.col(SCORES[name])
    high, medium, detail = fv.RISK_SIGNALS[name]
    level = risk_level(score, high, medium)
    if name == "Completion likelihood":
        level = F.when(score >= high, "Strong").when(score >= medium, "Watch").otherwise("Weak")
    return F.struct(
        F.lit(name).alias("name"),
        F.round(score, 1).alias("score_pct"),
        level.alias("level"),
        F.lit(detail).alias("detail"),
    )


def signals() -> Column:
    """The seven signals of a scored row as one array, in their fixed order."""
    return F.array(*[_signal(name) for name in SCORES])


def risk_signals(scored: DataFrame) -> DataFrame:
    """R1, long: one row per job and signal."""
    return scored.select("job_id", F.inline(signals()))


def recommendations() -> Column:
    """R2: advice texts of a scored row, a default text if none applies."""
    advice = F.array_compact(
        F.array(
            F.when(F.col("hse_pct") >= 3, fv.RECOMMEND_HSE),
            F.when(F.col("programme_pct") >= 10, fv.RECOMMEND_PROGRAMME),
            F.when(F.col("cancellation_pct") >= 8, fv.RECOMMEND_CANCELLATION),
            F.when(F.col("margin_pct") >= 15, fv.RECOMMEND_MARGIN),
        )
    )
    return F.when(F.size(advice) > 0, advice).otherwise(F.array(F.lit(fv.RECOMMEND_DEFAULT)))


def evidence(scored: DataFrame) -> DataFrame:
    """The counts and prices behind the scores."""
    mean_price = F.col("price_total").cast("double") / F.col("priced_jobs")
    return scored.select(
        "job_id",
        F.col("total_jobs").alias("scaffolder_jobs"),
        F.col("similar_n").alias("similar_jobs_used"),
        F.col("hse_signals").alias("hse_events"),
        F.col("damage_signals").alias("damage_events"),
        F.coalesce(F.round(F.when(F.col("priced_jobs") > 0, mean_price), 2), F.lit(0.0)).alias(
            "avg_scaffolder_price"
        ),
        F.coalesce(F.round("median_price", 2), F.lit(0.0)).alias("median_scaffolder_price"),
        pct(F.col("says_completed_jobs") / F.col("total_jobs")).alias("completion_rate_pct"),
        pct(F.col("cancelled_jobs") / F.col("total_jobs")).alias("cancellation_rate_pct"),
    )


def commercial_view(scored: DataFrame) -> DataFrame:
    """margin of the quoted job and its distance from the team's median price."""
    price, cost = F.col("price"), F.col("cost")
    return scored.select(
        "job_id",
        F.round(gross_margin(price, cost), 2).alias("gross_margin"),
        F.round(gross_margin_pct(price, cost), 2).alias("gross_margin_pct"),
        F.round(price - F.coalesce(F.round("median_price", 2), F.lit(0.0)), 2).alias("price_vs_median"),
    )
