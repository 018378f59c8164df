"""Job history per team and how much of it is similar to an intake job.

History is reduced to additive facts: per team, job type, area and price the numbers of jobs and
of events. Everything asked of it is a sum over facts, so facts of several tables, or of the
batches of a stream, add up (``History``). An intake job is never paired with history rows: it
reads counts per team, team and job type, team and area, and all three by equi-joins, and the
price band by ``band_edges``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from jobsight.operators.ordered import band_edges, quantiles_of_sized
from jobsight.session import stage

SCOPE = ["level", "scope_type", "scope_area"]
MEASURES = ["n", "completed", "cancelled"]
# What is counted per fact, and the flag of a job that it counts.
COUNTS = {
    "n": None, "done": "is_completed", "cancelled": "is_cancelled", "completed": "says_completed",
    "hse_jobs": "hse_event", "damage_jobs": "damage_event", "hse_category": "hse_category", "hse_dated": "hse_dated",
    "riddor": "riddor", "c_damagestatus": "c_damagestatus", "c_damagecategory": "c_damagecategory",
    "c_damagedescription": "c_damagedescription",
}
FACT_KEY = ["team_key", "job_type_key", "area", "budget_revenue"]


def _counted() -> list[Column]:
    return [(F.count(F.lit(1)) if flag is None else F.count_if(flag)).alias(name) for name, flag in COUNTS.items()]


@dataclass(frozen=True)
class History:
    """Additive facts of a history: per team, type, area and price; of all jobs (rows that add
    up); and how often a team is named in which spelling."""

    facts: DataFrame
    totals: DataFrame
    names: DataFrame

    @staticmethod
    def of(jobs: "DataFrame | History") -> "History":
        """The history of a canonical jobs table; a history stays as it is."""
        if isinstance(jobs, History):
            return jobs
        return History(team_facts(jobs), jobs.agg(*_counted()), named_teams(jobs))

    @staticmethod
    def dealt(jobs: "DataFrame | History") -> "History":
        """The history of a canonical jobs table for one who reads its facts several times and throws
        them away: one fact per job and team, written once with the facts of a team side by side, so
        that counts by team are nearly complete before they are shuffled. Very large teams are split."""
        if isinstance(jobs, History):
            return jobs.staged()
        return History(stage(team_rows(jobs).hint("rebalance", "team_key"), "team_facts"), jobs.agg(*_counted()), named_teams(jobs))

    def staged(self) -> "History":
        """The same with its facts written once, for operators that read them several times."""
        return History(stage(self.facts, "team_facts"), self.totals, self.names)


def team_history(jobs: DataFrame) -> DataFrame:
    """One row per job and distinct team of the job."""
    return jobs.select("*", F.explode("team_keys").alias("team_key"))


def team_facts(jobs: DataFrame) -> DataFrame:
    """Per team, job type, area and price the counts of ``COUNTS``."""
    return team_history(jobs).groupBy(*FACT_KEY).agg(*_counted())


def team_rows(jobs: DataFrame) -> DataFrame:
    """The facts of ``team_facts`` before they are summed: one per job and team."""
    flags = [
        (F.lit(1) if flag is None else F.coalesce(flag, F.lit(False)).cast("int")).cast("long").alias(name)
        for name, flag in COUNTS.items()
    ]
    return team_history(jobs).select(*FACT_KEY, *flags)


def named_teams(jobs: DataFrame) -> DataFrame:
    """(team_key, name, times): how often a team is named in which spelling.

    A name repeated inside one cell counts twice here, once in the facts.
    """
    spellings = jobs.select(F.explode("teams").alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("times"))
    return spellings.select(F.lower("name").alias("team_key"), "name", "times")


def team_names(jobs: DataFrame | History) -> DataFrame:
    """Per team key: its most frequent spelling and how often the team is named."""
    summed = History.of(jobs).names.groupBy("team_key", "name").agg(F.sum("times").alias("times"))
    return summed.groupBy("team_key").agg(
        F.min_by("name", F.struct(-F.col("times"), F.col("name"))).alias("team"),
        F.sum("times").alias("frequency"),
    )


def team_statistics(jobs: DataFrame | History) -> DataFrame:
    """One row per team: job counts, both event definitions, mean and exact median price."""
    facts = History.of(jobs).facts
    price, priced = F.col("budget_revenue"), F.col("budget_revenue").isNotNull()
    counts = facts.groupBy("team_key").agg(
        F.sum("n").alias("total_jobs"),
        F.sum("done").alias("completed_jobs"),
        F.sum("cancelled").alias("cancelled_jobs"),
        F.sum("completed").alias("says_completed_jobs"),
        F.sum("hse_jobs").alias("hse_jobs"),
        F.sum("damage_jobs").alias("damage_jobs"),
        *signal_counts(),
        F.sum(price.try_cast("decimal(28,6)") * F.col("n").cast("decimal(10,0)")).alias("price_total"),
        F.coalesce(F.sum(F.when(priced, F.col("n"))), F.lit(0)).alias("priced_jobs"),
        F.count_if(priced).alias("_points"),
    )
    counts = stage(counts, "team_counts")
    sizes = counts.where("_points > 0").select("team_key", F.col("priced_jobs").alias("_rows"), "_points")
    medians = quantiles_of_sized(facts, sizes, ["team_key"], "budget_revenue", {"median_price": 0.5}, "n")
    return counts.drop("_points").join(medians, "team_key", "left")


def signal_counts() -> list[Column]:
    """Event counts by the largest single column, as the risk scores use them.

    This differs on purpose from the per-row OR of ``hse_event`` and ``damage_event`` (A13).
    """
    total = lambda c: F.sum(c)
    return [
        (F.greatest(total("hse_category"), total("hse_dated")) + total("riddor")).alias("hse_signals"),
        F.greatest(total("c_damagestatus"), total("c_damagecategory"), total("c_damagedescription")).alias("damage_signals"),
    ]


def scoped_history(jobs: DataFrame | History) -> DataFrame:
    """Facts once per level they can be asked at: team, type, area, both."""
    nothing = F.lit("")

    def scope(level: str, job_type: Column, area: Column) -> Column:
        return F.struct(
            F.lit(level).alias("level"), job_type.alias("scope_type"), area.alias("scope_area")
        )

    job_type, area = F.col("job_type_key"), F.col("area")
    levels = F.array(
        scope("team", nothing, nothing),
        scope("type", job_type, nothing),
        scope("area", nothing, area),
        scope("both", job_type, area),
    )
    return (
        History.of(jobs).facts
        .select("team_key", "budget_revenue", *MEASURES, F.inline(levels))
        .where(F.col("scope_type").isNotNull() & F.col("scope_area").isNotNull())
    )


def match_counts(jobs: DataFrame | History, by: list[str]) -> DataFrame:
    """Rows, completed and cancelled jobs of every team per value of ``by``."""
    return (
        History.of(jobs).facts.where(" and ".join(f"{c} is not null" for c in by))
        .groupBy("team_key", *by).agg(*[F.sum(m).alias(m) for m in MEASURES])
    )


def with_match_counts(asked: DataFrame, jobs: DataFrame | History) -> DataFrame:
    """Add to rows (team_key, job_type_key, area) the counts of the team's history that match
    by type (``type_*``), by area (``area_*``) and by both (``both_*``)."""
    result = asked
    for prefix, by in (
        ("type", ["job_type_key"]), ("area", ["area"]), ("both", ["job_type_key", "area"]),
    ):
        found = match_counts(jobs, by).withColumnsRenamed({m: f"{prefix}_{m}" for m in MEASURES})
        result = result.join(found, ["team_key", *by], "left").fillna(0, [f"{prefix}_{m}" for m in MEASURES])
    return result


def with_narrowed_history(asked: DataFrame, jobs: DataFrame | History, gate: int) -> DataFrame:
    """Add to rows (team_key, job_type_key, area, total_jobs, says_completed_jobs, cancelled_jobs) the
    level their team's history is narrowed to (``SCOPE``) and what it counts there (``scope_rows``,
    ``scope_completed``, ``scope_cancelled``).

    By job type, then by area; a step that leaves fewer than ``gate`` (at least 1) jobs is not taken. So
    only matches of ``gate`` jobs or more are joined, and those of type and area are counted in types
    that have as many.
    """
    def found(history: History, prefix: str, by: list[str]) -> DataFrame:
        enough = match_counts(history, by).where(F.col("n") >= gate)
        return stage(enough.withColumnsRenamed({m: f"{prefix}_{m}" for m in MEASURES}), f"found_{prefix}")

    jobs = History.of(jobs)
    types = found(jobs, "type", ["job_type_key"])
    of_types = jobs.facts.join(types.select("team_key", "job_type_key"), ["team_key", "job_type_key"], "left_semi")
    both = found(History(of_types, jobs.totals, jobs.names), "both", ["job_type_key", "area"])
    areas = found(jobs, "area", ["area"])
    matched = (
        asked.join(types, ["team_key", "job_type_key"], "left")
        .join(both, ["team_key", "job_type_key", "area"], "left").join(areas, ["team_key", "area"], "left")
    )
    by_type = F.col("type_n").isNotNull()
    by_area = F.when(by_type, F.col("both_n")).otherwise(F.col("area_n")).isNotNull()
    whole = {"n": "total_jobs", "completed": "says_completed_jobs", "cancelled": "cancelled_jobs"}
    counts = [
        F.when(by_type & by_area, F.col(f"both_{m}")).when(by_type, F.col(f"type_{m}"))
        .when(by_area, F.col(f"area_{m}")).otherwise(F.col(whole[m])).alias("scope_rows" if m == "n" else f"scope_{m}")
        for m in MEASURES
    ]
    level = F.when(by_type & by_area, "both").when(by_type, "type").when(by_area, "area").otherwise("team")
    return matched.select(
        *[F.col(c) for c in asked.columns], level.alias("level"),
        F.when(by_type, F.col("job_type_key")).otherwise(F.lit("")).alias("scope_type"),
        F.when(by_area, F.col("area")).otherwise(F.lit("")).alias("scope_area"), *counts,
    )


def scope_columns(use_type: Column, use_area: Column) -> list[Column]:
    """The level an asked row reads history at, given which of its filters are on, and
    how many history rows that level holds."""
    both = use_type & use_area
    return [
        F.when(both, "both").when(use_type, "type").when(use_area, "area")
        .otherwise("team").alias("level"),
        F.when(use_type, F.col("job_type_key")).otherwise(F.lit("")).alias("scope_type"),
        F.when(use_area, F.col("area")).otherwise(F.lit("")).alias("scope_area"),
        F.when(both, F.col("both_n")).when(use_type, F.col("type_n")).when(use_area, F.col("area_n"))
        .otherwise(F.col("total_jobs")).alias("scope_rows"),
    ]


def price_band_edges(
    jobs: DataFrame | History, probes: DataFrame, probe_id: list[str], measures: list[str] = MEASURES
) -> DataFrame:
    """Rows per probe that add up to its history counts with a price within a quarter of
    the asked price.

    ``probes`` is a staged table with ``probe_id``, ``team_key``, the scope columns,
    ``scope_rows`` and ``price``. Facts are told apart by the levels that are asked of their team
    before they are dealt.
    """
    levels = stage(probes.select("team_key", "level").distinct(), "asked_levels")
    banded = probes.withColumn("low", F.col("price") * 0.75).withColumn("high", F.col("price") * 1.25)
    return band_edges(
        scoped_history(jobs).join(levels, ["team_key", "level"], "left_semi"), banded, ["team_key", *SCOPE], "budget_revenue", "low", "high",
        measures, probe_id, "scope_rows",
    )


def price_band_counts(jobs: DataFrame | History, probes: DataFrame, probe_id: list[str]) -> DataFrame:
    """One row per probe with its counts."""
    edges = price_band_edges(jobs, probes, probe_id)
    return edges.groupBy(*probe_id).agg(*[F.sum(m).alias(m) for m in MEASURES])
