"""Risk scores, leaderboard, cards and decisions against a naive plain-Python model."""

from __future__ import annotations

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobsight import fixed_values as fv
from jobsight.operators import decisions, entities, history, ingest, leaderboard, ordered, risk, teams
from jobsight.plans import workflows
from jobsight.session import stage

TYPES, AREAS = ["Roof repair", "Gable", "Render"], ["N1 1AA", "N2 2BB", "SW1A 1AA"]
STATUSES = ["Booked", "Scaffold Down", "Cancelled by client", "Handed Over", "On hold", "Cancelled - complete"]


@pytest.fixture(scope="module")
def raw():
    rng = random.Random(11)
    rows = []
    for i in range(600):
        contacts = rng.choice(["Alpha", "alpha | Beta", "Beta", "Gamma|Gamma", "Alpha|Delta", None])
        rows.append((
            f"JOB-{i:06d}", f"Client {i % 9}", contacts, rng.choice(STATUSES + [None]), f"2024-{1 + i % 12:02d}-10",
            f"2024-{1 + i % 12:02d}-2{i % 9}", rng.choice(AREAS + [None]), rng.choice(TYPES + [None]),
            rng.choice([f"£{rng.randint(100, 2000)}", "n/a", f"{rng.uniform(100, 900):.2f}"]),
            rng.choice(["Fall", None, None, " "]), rng.choice(["01/02/2024", "bad", None, None]),
            rng.choice(["0", "1", None]), rng.choice(["Open", None, None]), rng.choice(["Tile", None, None]),
        ))
    return rows


COLUMNS = ("project_no contact_name related_contacts status date due_date c_homeownerpostcode c_scaffoldpurpose "
           "budget_revenue c_hscategory c_hsincidentdate c_riddorreportable c_damagestatus c_damagecategory").split()


@pytest.fixture(scope="module")
def jobs(spark, raw):
    return ingest.canonical_jobs(spark.createDataFrame(raw, ", ".join(f"{c} string" for c in COLUMNS)))


@pytest.fixture(scope="module")
def asked():
    return [
        ("a", "ALPHA ", "Roof repair", "N1 9ZZ", "500", "400", "2024-05-01", "2024-05-02"),
        ("b", "Beta", "gable", "sw1a1aa", "1200", None, "2024-05-01", "2024-04-01"),
        ("c", "Delta", None, None, None, None, None, None),
        ("d", "gamma", "Unheard of", "E9 1AA", "£150", "160", "01/05/2024", "06/05/2024"),
        ("e", "Nobody", "Render", "N1 1AA", "1", None, None, None),
        ("f", " ", "Render", "N1 1AA", "1", None, None, None),
    ]


@pytest.fixture(scope="module")
def intake(spark, asked):
    names = "job_id related_contacts c_scaffoldpurpose c_homeownerpostcode budget_revenue budget_cost date due_date".split()
    return ingest.canonical_intake(spark.createDataFrame(asked, ", ".join(f"{c} string" for c in names)))


def price_of(text):
    kept = "".join(ch for ch in text or "" if ch in "0123456789.-")
    return float(kept) if kept else None


def naive_history(raw, key):
    """The team's jobs as dictionaries, straight from the raw cells."""
    found = []
    for row in raw:
        job = dict(zip(COLUMNS, row))
        if key in [p.strip().lower() for p in (job["related_contacts"] or "").split("|") if p.strip()]:
            text = (job["status"] or "").lower()
            job["cancelled"] = any(w in text for w in fv.CANCELLED_WORDS)
            job["says_done"] = any(w in text for w in fv.COMPLETED_WORDS)
            job["price"] = price_of(job["budget_revenue"])
            job["area"] = (job["c_homeownerpostcode"] or "").split(" ")[0]
            job["type"] = (job["c_scaffoldpurpose"] or "").lower()
            found.append(job)
    return found


@pytest.mark.parametrize("small_group", [10 ** 9, 20])
def test_similar_history_is_sequential(spark, raw, jobs, intake, small_group, monkeypatch):
    monkeypatch.setattr(ordered, "SMALL_GROUP", small_group)
    got = {r.job_id: r for r in risk.with_similar_history(intake, jobs).collect()}
    assert set(got) == {"a", "b", "c", "d"}
    for job in got.values():
        rows = naive_history(raw, job.team_key)
        assert job.total_jobs == len(rows)
        steps = [lambda r: r["type"] == job.job_type_key, lambda r: r["area"] == job.area,
                 lambda r: r["price"] is not None and 0.75 * job.price <= r["price"] <= 1.25 * job.price]
        given = [job.job_type_key is not None, job.area is not None, job.price is not None]
        for on, step in zip(given, steps):
            if on and sum(map(step, rows)) >= 10:
                rows = [r for r in rows if step(r)]
        assert job.similar_n == len(rows)
        assert job.similar_completed == sum(r["says_done"] for r in rows)
        assert job.similar_cancelled == sum(r["cancelled"] for r in rows)


def test_the_search_for_similar_jobs_carries_narrow_rows(spark, jobs, intake, monkeypatch):
    """Counts, level and price per row; names, texts and statistics are not shuffled with each step."""
    kept = {}

    def noted(df, name):
        kept[name] = df.columns
        return stage(df, name)

    for module in (risk, history):
        monkeypatch.setattr(module, "stage", noted)
    risk.with_similar_history(intake, jobs)
    assert set(kept["asked_history"]) == {
        "row_id", "team_key", "price", "level", "scope_type", "scope_area", "scope_rows", "scope_completed", "scope_cancelled"
    }
    assert {"found_type", "found_area", "found_both"} <= set(kept)


def test_facts_of_a_team_lie_side_by_side_and_add_up(spark, jobs):
    def summed(facts):
        per_fact = facts.groupBy(*history.FACT_KEY).agg(*[F.sum(c).alias(c) for c in history.COUNTS])
        return sorted(map(str, per_fact.collect()))

    dealt = history.History.dealt(jobs).facts
    assert dealt.count() == history.team_history(jobs).count()
    assert summed(dealt) == summed(history.team_facts(jobs))


def test_leaderboard_gates_and_ranks(spark, raw, jobs, intake):
    pairs = {(r.job_id, r.team): r for r in teams.with_similar_jobs(teams.candidate_pairs(intake, jobs), jobs).collect()}
    for (_, team), row in pairs.items():
        rows = naive_history(raw, team.lower())
        hit = {
            "type": [r["type"] == row.job_type_key for r in rows],
            "area": [r["area"] == row.area for r in rows],
            "price": [row.price is not None and r["price"] is not None
                      and 0.75 * row.price <= r["price"] <= 1.25 * row.price for r in rows],
        }
        open_gates = [flags for flags in hit.values() if sum(flags) >= 3]
        assert row.similar_jobs == sum(all(f[i] for f in open_gates) for i in range(len(rows)))
        prices = [r["price"] for r in rows if r["price"] is not None]
        assert row.median_price == pytest.approx(statistics.median(prices))
    ranked = teams.ranked_teams(intake, jobs).collect()
    for job in {r.job_id for r in ranked}:
        places = sorted((r.rank, -r.fit_score) for r in ranked if r.job_id == job)
        assert [p for p, _ in places] == list(range(1, len(places) + 1))
        assert [s for _, s in places] == sorted(s for _, s in places)
    shown = teams.shown_teams(teams.ranked_teams(intake, jobs), limit=2).collect()
    for job in {r.job_id for r in shown}:
        mine = [r for r in shown if r.job_id == job]
        assert len(mine) == 2 and any(r.is_selected for r in mine)


def test_compared_pairs_are_those_of_the_join(spark, jobs, intake):
    """The arrays of places give what a table of jobs times teams, joined with the history, gives."""
    columns = ["row_id", "team", "candidate_rank", "is_selected", "type_n", "area_n", "price_n", "similar_jobs"]
    joined = teams.with_similar_jobs(teams.candidate_pairs(intake, jobs), jobs).select(*columns).collect()
    found = leaderboard.compared_pairs(intake, jobs).select(*columns).collect()
    assert len(found) > 0 and sorted(found) == sorted(joined)


def test_ranked_teams_are_not_shuffled(spark, jobs, intake, capsys):
    """Ranks of all compared teams follow job by job, behind the last shuffle."""
    capsys.readouterr()
    teams.ranked_teams(intake, jobs).explain("simple")
    above = capsys.readouterr().out.split("MapInArrow")[0]
    assert "Exchange" not in above and "Window" not in above and "Join" not in above


def test_ranked_teams_are_not_written(spark, jobs, intake):
    """Ranks and fit classes of all compared teams are run, not read from a written table of 121 rows a job."""
    from catalog.base import QUERIES
    import catalog.all  # noqa: F401

    for name in ("w1_leaderboard_rank", "r5_fit_class"):
        found = QUERIES[name](spark, "/root/testdata/sf0.001")
        assert not any("ranked_teams" in path for path in found.inputFiles())
    full, short = teams.ranked_teams(intake, jobs), teams.ranked_teams(intake, jobs, shown=False)
    assert short.columns == ["row_id", "job_id", "team", "fit_score", "rank"]
    assert sorted(full.select(short.columns).collect()) == sorted(short.collect())


def test_counts_travel_in_few_bytes():
    counts = np.zeros((4, leaderboard.PLACES), np.int64)
    counts[1, 3], counts[2, 5], counts[3, 0] = 255, 256, 2**40
    packed = leaderboard._packed(counts)
    assert [len(row) // leaderboard.PLACES for row in packed.to_pylist()] == [1, 1, 2, 8]
    assert (leaderboard._unpacked(packed) == counts).all()


def test_a_job_without_a_price_gets_the_neutral_price_fit(spark):
    """Eight completed jobs of one team: 31 + 17 + 12 + 8, half of 12 and of 7, 8 for similar jobs, 0.62 of 5."""
    rows = [(f"J{i}", "Solo", "Handed Over", 1000.0) for i in range(8)]
    jobs = ingest.canonical_jobs(spark.createDataFrame(rows, "project_no string, related_contacts string, status string, budget_revenue double"))
    asked = spark.createDataFrame([("x", "solo", None), ("y", "solo", "1000")], "job_id string, related_contacts string, budget_revenue string")
    got = {r.job_id: r.fit_score for r in teams.ranked_teams(ingest.canonical_intake(asked), jobs).collect()}
    assert got == {"x": round(68 + 9.5 + 6.4 + 3.1, 1), "y": round(68 + 9.5 + 6.4 + 5.0, 1)}


def test_partitioning_does_not_change_results(spark, jobs, intake):
    one = sorted(teams.team_leaderboard(intake, jobs).collect())
    two = sorted(teams.team_leaderboard(intake.repartition(5), jobs.repartition(13)).collect())
    assert one == two
    first = sorted(map(str, risk.risk_signals(risk.risk_scores(intake, jobs)).collect()))
    again = sorted(map(str, risk.risk_signals(risk.risk_scores(intake.repartition(3), jobs.repartition(1))).collect()))
    assert first == again


def test_errors_name_the_reason(intake, jobs):
    got = {r.job_id: r.error for r in risk.intake_errors(intake, jobs).collect()}
    assert set(got) == {"e", "f"}
    assert "No historical jobs found for scaffolder 'Nobody'" in got["e"] and "required" in got["f"]


def test_known_scores(spark):
    """A hand-computed job: ten jobs of one team, eight completed, one cancelled, one incident."""
    rows = [(f"J{i}", "Solo", "Handed Over" if i < 8 else "Cancelled" if i == 8 else "Booked", 1000.0, "Fall" if i == 0 else None)
            for i in range(10)]
    jobs = ingest.canonical_jobs(
        spark.createDataFrame(rows, "project_no string, related_contacts string, status string, budget_revenue double, c_hscategory string")
    )
    asked = spark.createDataFrame(
        [("x", "solo", "Roof", "700", "650", "2024-01-01", "2024-01-03")],
        "job_id string, related_contacts string, c_scaffoldpurpose string, budget_revenue string, budget_cost string, date string, due_date string",
    )
    scored = risk.risk_scores(ingest.canonical_intake(asked), jobs)
    row = scored.first()
    # The price band 525..875 holds no job, so all ten jobs are the similar set.
    assert row.completion_pct == 62.0  # 0.8 - 0.18
    assert row.cancellation_pct == 28.0  # 0.1 + 0.18
    assert row.hse_pct == 22.0  # 2/20 + 0.06 + 0.18/3
    assert row.damage_pct == 4.0  # 0 + 0.04
    assert row.margin_pct == 47.0  # below 75% of the median, margin 7.1%
    assert row.programme_pct == 28.0
    assert row.failure_pct == 38.0
    decided = decisions.with_decision(scored).first()
    assert (decided.decision, decided.priority) == ("Escalate before booking", "Price / margin pressure")
    assert decided.rationale == "5 high-priority signals detected."
    assert scored.select(F.size(risk.recommendations())).first()[0] == 4


def test_cards(spark, raw, jobs):
    card = {r.entity: r for r in entities.profile_cards(jobs, entities.PARTNER, F.lit("2024-06-01").cast("timestamp_ntz")).collect()}
    alpha = naive_history(raw, "alpha")
    assert card["alpha"].total_jobs == len(alpha)
    assert card["alpha"].cancelled_jobs == sum(r["cancelled"] for r in alpha)
    assert len(card["alpha"].recent_jobs) == 10 and card["alpha"].recent_jobs[0].place == 1
    assert card["gamma"].total_jobs == sum(r[2] == "Gamma|Gamma" for r in raw)
    names = {r.name: r.jobs for r in entities.entity_list(jobs, entities.PARTNER).collect()}
    assert names["Gamma"] == 2 * card["gamma"].total_jobs
    assert card["alpha"].avg_total_done_hours is None
    one = entities.profile_card(jobs, entities.PARTNER, " ALPHA", F.lit("2024-06-01").cast("timestamp_ntz")).collect()
    assert one == [card["alpha"]]
    with pytest.raises(ValueError, match="No records found for client 'Zed'"):
        entities.profile_card(jobs, entities.CLIENT, "Zed")
    with pytest.raises(ValueError):
        entities.entity_jobs(jobs, "team")


def test_missing_optional_columns(spark, intake):
    bare = ingest.canonical_jobs(spark.createDataFrame([("Alpha",)] * 9, "related_contacts string"))
    row = teams.ranked_teams(intake, bare).where("job_id = 'a'").first()
    assert (row.total_jobs, row.similar_jobs, row.median_price, row.rank) == (9, 9, None, 1)


def test_readiness(spark, asked):
    df = spark.createDataFrame([("a", "Alpha", "", "x")], "job_id string, related_contacts string, c_homeownerpostcode string, c_scaffoldpurpose string")
    row = ingest.intake_readiness(df).first()
    assert (row.present, row.ready_pct, row.missing) == (2, 33, "Postcode, Erect date, Install / due date, Job price")


def test_score_jobs_workflow(spark, raw, asked):
    jobs = spark.createDataFrame(raw, ", ".join(f"{c} string" for c in COLUMNS))
    names = "job_id related_contacts c_scaffoldpurpose c_homeownerpostcode budget_revenue budget_cost date due_date".split()
    out = workflows.score_jobs(spark.createDataFrame(asked, ", ".join(f"{c} string" for c in names)), jobs)
    assert out["signals"].count() == 4 * 7
    assert out["assessments"].count() == 4 and out["errors"].count() == 2
    log = out["assessments"]
    assert decisions.assessment_highlights(log).first().runs == 4


def test_rows_with_equal_or_no_job_ids_are_scored_alone(spark, raw, jobs, asked):
    """Two intake rows with one id, or with none, don't add up."""
    names = "job_id related_contacts c_scaffoldpurpose c_homeownerpostcode budget_revenue budget_cost date due_date".split()
    schema = ", ".join(f"{c} string" for c in names)
    alone = {r[0]: r for r in asked[:4]}
    rows = [("same", *alone["a"][1:]), ("same", *alone["a"][1:]), ("same", *alone["b"][1:]), (None, *alone["a"][1:]), (None, *alone["d"][1:])]
    history_rows = spark.createDataFrame(raw, ", ".join(f"{c} string" for c in COLUMNS))

    def results(given):
        out = workflows.score_jobs(spark.createDataFrame(given, schema), history_rows)
        scores = sorted(tuple(r) for r in out["scores"].select("partner", "similar_n", "failure_pct", "hse_pct").collect())
        boards = sorted(tuple(r) for r in out["leaderboard"].select("team", "rank", "fit_score", "similar_jobs").collect())
        logged = sorted((r["scaffolder"], r["best_team"], r["fit_score"]) for r in out["assessments"].collect())
        return scores, boards, logged

    together = results(rows)
    single = [results([(f"r{i}", *r[1:])]) for i, r in enumerate(rows)]
    for k in range(3):
        assert together[k] == sorted(x for s in single for x in s[k])


def test_stream_keeps_what_cannot_be_scored(spark, raw, asked, jobs, tmp_path):
    from jobsight.streaming import intake as streaming

    names = "job_id related_contacts c_scaffoldpurpose c_homeownerpostcode budget_revenue budget_cost date due_date".split()
    spark.createDataFrame(asked, ", ".join(f"{c} string" for c in names)).write.parquet(f"{tmp_path}/in")
    stream = streaming.read_intake_files(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema)
    streaming.score_stream(stream, lambda: jobs, f"{tmp_path}/out", f"{tmp_path}/checkpoint").awaitTermination()
    scored = {r.job_id for r in spark.read.parquet(f"{tmp_path}/out/scores").collect()}
    errors = {r.job_id: r.error for r in spark.read.parquet(f"{tmp_path}/out/errors").collect()}
    assert scored == {"a", "b", "c", "d"} and set(errors) == {"e", "f"} and "Nobody" in errors["e"]
