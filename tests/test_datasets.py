"""Files, cleaning, preparation, profile and drift."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from jobsight import fixed_values as fv
from jobsight.operators import clean, drift, features, prepare, profile
from jobsight.plans import workflows
from jobsight.sources import files


def frame(spark, n, kind):
    rows = range(n)
    groups = ["complete"] * 45 + ["cancelled"] * 30 + ["active"] * 15
    if kind == "identifier":
        return spark.createDataFrame(
            [(f"P-{i:04d}", "complete" if i < 30 else "active", i) for i in rows],
            "project_no string, status_group string, budget_cost long")
    return spark.createDataFrame(
        [(f"P-{i:04d}", groups[i], float(i * 10)) for i in rows], "project_no string, status_group string, budget_cost double")


def test_identifier_target_is_blocked(spark):
    row = profile.target_profiles(frame(spark, 60, "identifier"), ["project_no"]).first()
    assert not row.is_trainable and row.quality == "blocked"
    assert any("identifier" in r for r in row.reasons)


def test_candidates_from_a_csv_file(spark, tmp_path):
    path = str(tmp_path / "jobs.csv")
    files.write_dataset(frame(spark, 90, "candidates"), path)
    found = workflows.profile_data(spark, path)
    names = [r.column for r in found["target_candidates"].collect()]
    assert names == ["status_group", "budget_cost"]
    assert {r.section for r in found["profile"].collect()} == {"size", "dtype_breakdown", "top_missing_pct", "top_cardinality"}


def test_target_rules(spark):
    df = spark.createDataFrame(
        [(i, None if i % 2 else "x", "a" if i else "b", i % 3, None, f"2024-01-{1 + i % 28:02d}") for i in range(100)],
        "n long, half_empty string, lonely string, small long, empty string, due_date string")
    got = {r.column: r for r in profile.target_profiles(df).collect()}
    assert got["n"].effective_task_type == "regression" and got["n"].quality == "ready"
    assert got["small"].effective_task_type == "classification" and got["small"].is_trainable
    assert got["half_empty"].missing_pct == 50.0 and got["half_empty"].warnings == ["Target is 50.0% empty."]
    assert fv.REASON_SINGLE_ROW_CLASS in got["lonely"].reasons
    assert got["empty"].rows == 100 and "Target is 100.0% empty." in got["empty"].reasons
    assert got["due_date"].warnings == [fv.WARNING_DATE_CLASS]
    assert (got["n"].median, got["n"].numeric_unique_count) == (49.5, 100)


@pytest.mark.parametrize("separator", [",", ";", "|", "\t"])
def test_delimiters(spark, tmp_path, separator):
    path = tmp_path / "x.txt"
    path.write_text(f"a{separator}b c{separator}d\n1{separator}\"x, y; z|\"{separator}3\n", encoding="utf-8")
    df = files.load_dataset(spark, str(path))
    assert df.columns == ["a", "b c", "d"] and df.first() == ("1", "x, y; z|", "3")


def test_utf16_and_bom(spark, tmp_path):
    (tmp_path / "w.csv").write_text("a;b\né;2\n", encoding="utf-16")
    assert files.load_dataset(spark, str(tmp_path / "w.csv"), encoding="UTF-16").first() == ("é", "2")
    (tmp_path / "b.csv").write_text("a;b\né;2\n", encoding="utf-8-sig")
    assert files.load_dataset(spark, str(tmp_path / "b.csv")).columns == ["a", "b"]


def test_format_guard(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        files.load_dataset(spark, str(tmp_path / "none.csv"))
    (tmp_path / "x.doc").write_text("a")
    with pytest.raises(ValueError, match="Unsupported dataset type .doc"):
        files.load_dataset(spark, str(tmp_path / "x.doc"))


@pytest.mark.parametrize("suffix", [".parquet", ".json", ".orc", ".csv", ".tsv"])
def test_write_and_read_back(spark, tmp_path, suffix):
    path = str(tmp_path / f"t{suffix}")
    files.write_dataset(spark.createDataFrame([("x, \"y\"", "2")], "a string, b string"), path)
    assert files.load_dataset(spark, path).select("a", "b").collect() == [('x, "y"', "2")]


def test_clean_table(spark):
    rows = [(f" {i} ", f"0{1 + i % 9}/02/2024", "JOB-%06d" % i, "yes" if i % 2 else "N", "sw1 1aa", "1" if i % 2 else "0.0", None, " nan ")
            for i in range(20)]
    raw = spark.createDataFrame(
        rows + rows[:5],
        "`Job Size` string, `Booked-On` string, `Code #` string, C_EdgeProtection string, C_HomeownerPostcode string, Flag string, Void string, Blank string")
    got, plan = clean.clean_table(raw)
    assert plan.empty == ["void", "blank"] and plan.to_date == ["booked_on"]
    assert plan.to_number == ["job_size"] and plan.to_boolean == ["flag"]
    assert got.count() == 20
    row = got.where("job_size = 3").first()
    assert row.code == "JOB-000003" and row.c_homeownerpostcode == "SW11AA" and row.flag is True
    assert row.c_edgeprotection_normalized == "Yes" and str(row.booked_on.date()) == "2024-02-04"


def test_prepared_rows_keep_no_private_column(spark):
    rows = [(f"{i}", f"Client {i % 4}", f"Team {i % 3}", "Booked" if i % 5 else "Cancelled", "2024-01-0%d" % (1 + i % 9), "05/02/2024",
             "SW1A 1AA", "Roof", f"£{i}.50", "secret") for i in range(200)]
    names = ("project_no contact_name related_contacts status date due_date c_homeownerpostcode c_scaffoldpurpose "
             "budget_revenue c_homeownername").split()
    source = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names))
    policy = prepare.Policy(target_rows=90, top_teams=2, rows_per_team=30)
    safe, manifest = workflows.build_safe_dataset(source.repartition(6), policy)
    assert not set(safe.columns) & set(fv.PRIVATE_COLUMNS)
    got = safe.collect()
    assert [r.project_no for r in got] == [f"JOB-{i:06d}" for i in range(1, len(got) + 1)]
    assert {r.related_contacts for r in got} == {"Team 0", "Team 1"}
    assert {r.c_homeownerpostcode for r in got} == {"SW1A"} and got[0].budget_revenue % 1 == 0.5
    assert all(r.contact_name.startswith("Client 0") for r in got)
    record = manifest.first()
    assert (record.source_rows, record.output_rows, record.client_aliases) == (200, len(got), 4)
    assert record.dropped_columns == ["c_homeownername"]
    again, _ = workflows.build_safe_dataset(source, policy)
    assert again.collect() == got


def test_drift_bounds(spark):
    base = spark.createDataFrame([(float(i % 10), "ab"[i % 2], i) for i in range(100)], "x double, c string, gone long")
    signature = drift.baseline_signature(base)
    same = {r.feature: r.drift_score for r in drift.drift_by_feature(signature, base).collect()}
    assert set(same.values()) == {0.0}
    moved = base.select((F.col("x") + 100).alias("x"), F.lit("z").alias("c"))
    rows = {r.feature: r for r in drift.drift_by_feature(signature, moved).collect()}
    assert rows["x"].drift_score == 1.0 and rows["c"].drift_score == pytest.approx(1.0)
    assert rows["gone"].status == "missing_in_current_data"
    total = drift.drift_summary(drift.drift_by_feature(signature, moved)).first()
    assert total.is_alert and total.drifted_feature_count == 3


def test_drift_of_text_in_a_number_column(spark):
    signature = drift.baseline_signature(spark.createDataFrame([(1.0,), (3.0,)], "x double"))
    row = drift.drift_by_feature(signature, spark.createDataFrame([("2",), ("bad",), (None,)], "x string")).first()
    assert row.current_mean == 2.0 and row.drift_score == 0.0


def test_quoted_line_breaks_are_found(spark, tmp_path):
    """A cell with a line break keeps its row whole without any option."""
    for name, text in (("broken.csv", 'a,b\n"one\ntwo",3\nx,"y ""z"""\n'), ("plain.csv", 'a,b\n"one two",3\nx,y\n')):
        (tmp_path / name).write_text(text)
    rows = files.read_delimited(spark, str(tmp_path / "broken.csv")).collect()
    assert [tuple(r) for r in rows] == [("one\ntwo", "3"), ("x", 'y "z"')]
    assert not files.has_open_quotes(spark, str(tmp_path / "plain.csv"))
    assert files.read_delimited(spark, str(tmp_path / "plain.csv")).count() == 2


def test_encoding_reaches_the_profile(spark, tmp_path):
    (tmp_path / "latin.csv").write_bytes("Größe,price\nklein,£500.00\ngroß,£7\n".encode("latin-1"))
    df = workflows.typed_dataset(spark, str(tmp_path / "latin.csv"), encoding="ISO-8859-1")
    assert [r[1] for r in df.orderBy(df.columns[1]).collect()] == ["£500.00", "£7"] or df.count() == 2
    assert "ö" in df.columns[0]


def test_rows_without_a_number_stay(spark):
    """Rows are told apart by their whole content: null and repeated numbers don't drop any."""
    names = fv.REQUIRED_COLUMNS
    filled = [("x",) * len(names) for _ in range(20)]
    df = spark.createDataFrame([(None if i < 5 else f"P{i % 8}", f"note {i}", *r) for i, r in enumerate(filled)],
                               ", ".join(["project_no string", "note string", *[f"{c} string" for c in names if c != "project_no"], *(["extra string"] if "project_no" in names else [])]))
    df = df.withColumn("related_contacts", F.lit("Team")) if "related_contacts" not in df.columns else df
    assert prepare.select_rows(df).count() == prepare.complete_rows(df).count()
    assert prepare.select_rows(df.drop("project_no")).count() == 20
    assert prepare.select_rows(df.unionByName(df)).count() == prepare.complete_rows(df).count()  # equal rows are one


def test_no_column_is_left_out(spark):
    """Past the 250th column and the 150th candidate nothing is cut."""
    df = spark.createDataFrame([tuple(i % 2 for _ in range(260)) for i in range(40)], ", ".join(f"c{i} long" for i in range(260)))
    verdicts = profile.target_profiles(df)
    assert verdicts.count() == 260 and profile.target_candidates(verdicts).count() == 260
    assert profile.target_candidates(verdicts, 150).count() == 150 and profile.target_profiles(df, max_items=250).count() == 250


@pytest.mark.parametrize("values, sketch", [(39, 5), (40, 5), (41, 5), (39, 13), (40, 13), (41, 13), (500, 5)])
def test_wide_columns_on_both_sides_of_the_limit(spark, values, sketch):
    """Exact by the sketch alone, by a count where its bounds enclose the limit, or far above it."""
    df = spark.createDataFrame([(f"v{i % values}" if i % 5 else "", float(i), None) for i in range(2000)], "a string, n double, empty string")
    distinct = df.select("a").distinct().count()
    bounds = {r["column"]: r for r in features.distinct_bounds(df, df.columns, sketch).collect()}
    assert bounds["a"].at_least <= distinct <= bounds["a"].at_most and bounds["n"].at_most == 0
    if sketch == 13:
        assert bounds["a"].at_least == bounds["a"].at_most == distinct
    got = {r["column"]: r.drop_reason for r in features.droppable(df, None, 40, sketch).collect()}
    assert got == {"a": "high_cardinality" if distinct >= 40 else None, "n": None, "empty": "sparse"}


def test_counts_of_a_write(spark, tmp_path):
    """The log's counts are those of the written table, counted by the write itself."""
    rows = [(f" {i % 7} ", "2024-01-02", " nan ") for i in range(50)]
    df = spark.createDataFrame(rows, "`A b` string, booked string, none string")
    log = workflows.write_cleaned(df.repartition(4), str(tmp_path / "out.parquet"))
    last = log.where("step = 'drop_duplicates'").first()
    assert (last.rows_before, last.rows_after) == (50, 7) == (50, spark.read.parquet(str(tmp_path / "out.parquet")).count())
    tidy = clean.tidy_text(df.toDF("a_b", "booked", "none"))
    plan = clean.plan_cleaning(tidy)
    again = clean.cleaning_log(clean.apply_cleaning(tidy, plan), spark.read.parquet(str(tmp_path / "out.parquet")), plan)
    assert sorted(map(str, log.collect())) == sorted(map(str, again.collect()))


def test_signature_is_computed_once(spark, monkeypatch):
    seen = []
    signature = drift.baseline_signature(spark.createDataFrame([("a", 1.0), ("b", 2.0)], "c string, x double"))
    original = type(signature).collect
    monkeypatch.setattr(type(signature), "collect", lambda df: seen.append(df.columns) or original(df))
    drift.drift_by_feature(signature, spark.createDataFrame([("a", 5.0)], "c string, x double"))
    full = [c for c in seen if len(c) == 7]
    assert len(full) >= 1 and signature.columns in full


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    """Train, score from file to file and check drift, each in one call."""
    from jobsight import __main__ as command
    from jobsight.operators import train as training

    monkeypatch.setattr(command, "get_session", lambda: spark)
    small = lambda config, rows, classes: {k: v for k, v in candidates(config, rows, classes).items() if k == "logistic_regression"}
    candidates = training.candidate_models
    monkeypatch.setattr(training.train_and_select, "__defaults__", (None, small))
    rows = [("complete" if i % 2 else "active", float(i % 2 * 100 + i % 9), f"T{i % 3}") for i in range(120)]
    source = str(tmp_path / "jobs.csv")
    files.write_dataset(spark.createDataFrame(rows, "status_group string, budget_cost double, related_contacts string"), source)
    command.main(["train", source, "Status Group", str(tmp_path / "registry")])
    assert "logistic_regression" in capsys.readouterr().out
    command.main(["score", source, str(tmp_path / "scored.csv"), str(tmp_path / "registry")])
    scored = files.load_dataset(spark, str(tmp_path / "scored.csv"))
    assert scored.count() == 120 and scored.where("prediction = status_group").count() > 110
    command.main(["drift", source, str(tmp_path / "drift.parquet"), str(tmp_path / "registry"), "--threshold", "0.2"])
    assert "'is_alert': False" in capsys.readouterr().out
    assert spark.read.parquet(str(tmp_path / "drift.parquet")).where("status = 'stable'").count() == 2


def test_histogram_combines_few_columns_in_a_task(spark):
    names = [f"c{i}" for i in range(20)]
    rows = [tuple(None if (r + i) % 5 == 0 else str(r % (i + 1)) for i in range(20)) for r in range(40)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    found = profile.value_histogram(df)
    expected = Counter((n, v) for row in rows for n, v in zip(names, row))
    assert {(r["column"], r["value"]): r["n"] for r in found.collect()} == expected
    assert found.count() == len(expected)
    parts = found._jdf.queryExecution().optimizedPlan().toString().count("Expand")
    assert parts == profile.HISTOGRAM_PARTS  # one aggregate over parts of at most two columns
    assert profile.value_histogram(df, ["c3"]).where("value is null").first()["n"] == 8
