"""Column functions against hand-computed values and plain Python models."""

from __future__ import annotations

import datetime as dt
import math
import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from jobsight.functions import dates, naming, numbers, status, text
from jobsight.functions.optional import align_columns

FEW = settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])


def apply(spark, fn, values, dtype="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i long, v {dtype}")
    return [r.r for r in rows.select("i", fn(F.col("v")).alias("r")).orderBy("i").collect()]


def test_numeric_loose(spark):
    got = apply(spark, numbers.numeric_loose, ["£1,234.50", "(500)", "-5", "n/a", "", None, "1.2.3", "--5", "5.", "-.5", "12-"])
    assert got == [1234.5, 500.0, -5.0, None, None, None, None, None, 5.0, -0.5, None]


def test_numeric_strict(spark):
    got = apply(spark, numbers.numeric_strict, ["£1,234.567", "(500)", " 7 ", "n/a", "1000000", "1000000.01", "1e3", "5d", "NaN"])
    assert got == [1234.57, -500.0, 7.0, None, 1000000.0, None, 1000.0, None, None]


def test_numeric_text_refuses_letters(spark):
    assert apply(spark, numbers.numeric_text, ["£ 1,200", "JOB-000001", "1e3", "3 m"]) == [1200.0, None, 1000.0, None]


def test_parse_datetime(spark):
    got = apply(spark, dates.parse_datetime, [
        "2024-03-05", "05/03/2024", "25-12-2023 10:11:12", "2024-03-05T10:00:00", "0000-00-00", "NaT", "", None,
        "13/13/2024", "5 Mar 2024", "words", "1990",
    ])
    day = dt.datetime(2024, 3, 5)
    assert got == [day, day, dt.datetime(2023, 12, 25, 10, 11, 12), day.replace(hour=10), None, None, None, None,
                   None, day, None, None]


def test_duration_hours(spark):
    got = apply(spark, dates.duration_hours, ["02:30:00", "30:00:00", "1 day", "2 days 03:00:00", "90 min", "1.5", "-01:30:00", "x", None])
    assert got == [2.5, 30.0, 24.0, 51.0, 1.5, 1.5, -1.5, None, None]


def test_whole_days_rounds_down(spark):
    rows = spark.sql("""SELECT * FROM VALUES
      (TIMESTAMP_NTZ'2024-01-02 00:00:00', TIMESTAMP_NTZ'2024-01-01 01:00:00'),
      (TIMESTAMP_NTZ'2024-01-01 10:00:00', TIMESTAMP_NTZ'2024-01-03 09:00:00'),
      (TIMESTAMP_NTZ'2024-01-01 10:00:00', TIMESTAMP_NTZ'2024-01-03 10:00:00') AS t(a, b)""")
    assert [r[0] for r in rows.select(dates.whole_days(F.col("a"), F.col("b"))).collect()] == [-1, 1, 2]


def test_postcodes(spark):
    assert apply(spark, text.outward_postcode, [" sw1a  1aa", "SW1A1AA", "n13aa", "12345", "", None]) == [
        "SW1A", "SW1A", "N13", "1234", None, None]
    assert apply(spark, text.outward_simple, [" sw1a  1aa", "SW1A1AA", " "]) == ["SW1A", "SW1A1AA", None]
    assert apply(spark, text.compact_postcode, [" sw1a\t1aa", None]) == ["SW1A1AA", None]


def test_yes_no_and_blanks(spark):
    assert apply(spark, text.yes_no, [" Y ", "TRUE", "0", "f", " maybe ", None]) == ["Yes", "Yes", "No", "No", "maybe", None]
    assert apply(spark, text.missing_to_null, [" ", "nan", " a ", "0"]) == [None, None, "a", "0"]


def test_lists_and_membership(spark):
    assert apply(spark, text.list_parts, [" A | b||A ", "", None]) == [["A", "b", "A"], [], []]
    assert apply(spark, text.list_keys, [" A | b||a "]) == [["a", "b"]]
    member = lambda c: text.has_member(c, F.lit(" TEAM A "))
    assert apply(spark, member, ["x|team a", "team ab", None]) == [True, False, False]
    assert apply(spark, lambda c: text.has_member(c, F.lit(" ")), ["x"]) == [False]


def test_status_words(spark):
    cells = ["Cancelled - complete", "Incomplete", "Parts RTS", "On hold", None]
    assert apply(spark, status.status_group, cells) == ["cancelled", "completed", "active", "other", "other"]
    assert apply(spark, status.is_completed, cells) == [False, True, False, False, False]
    assert apply(spark, status.says_completed, cells) == [True, True, False, False, False]


def test_percentages(spark):
    assert apply(spark, numbers.pct, [0.1234, -1.0, 2.0], "double") == [12.3, 0.0, 100.0]
    assert apply(spark, lambda c: numbers.risk_level(c, 25, 12), [25.0, 12.0, 11.9], "double") == ["High", "Medium", "Low"]
    assert apply(spark, lambda c: numbers.variance_pct(F.lit(5.0), c), [10.0, 0.0, -10.0], "double") == [-50.0, 0.0, -150.0]
    assert apply(spark, lambda c: numbers.variance_pct(F.lit(-50.0), c), [-100.0], "double") == [-50.0]
    assert apply(spark, lambda c: numbers.variance_pct(F.lit(5.0), c, True), [10.0, 0.0, -10.0], "double") == [-50.0, 0.0, 150.0]


def test_names(spark):
    assert naming.plain_name(" Job Type/Area-1 ") == "job_type_area_1"
    assert naming.snake_name("__Job  (Type) #1 ") == "job_type_1"
    df = spark.createDataFrame([(1, 2, 3)], ["A b", "a-b", "c"])
    assert naming.normalize_columns(df).collect() == [(1, 3)]
    assert naming.resolve_target(naming.normalize_columns(df), "A-B") == "a_b"
    with pytest.raises(ValueError, match="not found"):
        naming.resolve_target(df, "zzz")
    hints = apply(spark, naming.target_hint, ["due_date", "project_no", "ID", "idea", "video", "contact_name"])
    assert hints == ["date", "identifier", "identifier", "standard", "standard", "identifier"]


def test_align_columns(spark):
    df = spark.createDataFrame([("1", "x")], ["b", "z"])
    out = align_columns(df, {"a": "double", "b": "long"})
    assert out.columns == ["a", "b"] and out.collect() == [(None, 1)]


@FEW
@given(st.lists(st.text(alphabet="0123456789.-£, ()abeE", max_size=9), min_size=1, max_size=80))
def test_numeric_loose_model(spark, cells):
    def model(cell):
        kept = re.sub(r"[^0-9.\-]", "", cell)
        try:
            return float(kept)
        except ValueError:
            return None

    assert apply(spark, numbers.numeric_loose, cells) == [model(c) for c in cells]


@FEW
@given(st.lists(st.text(alphabet="aB| \t,", max_size=10), min_size=1, max_size=80))
def test_list_parts_model(spark, cells):
    assert apply(spark, text.list_parts, cells) == [[p.strip() for p in c.split("|") if p.strip()] for c in cells]


@FEW
@given(st.lists(st.dates(dt.date(1990, 1, 1), dt.date(2090, 1, 1)), min_size=1, max_size=60))
def test_both_date_spellings_agree(spark, days):
    iso = apply(spark, dates.clean_date, [d.isoformat() for d in days])
    day_first = apply(spark, dates.clean_date, [f"{d.day}/{d.month}/{d.year}" for d in days])
    assert iso == day_first == days


@FEW
@given(st.lists(st.text(alphabet="AB1 2z", max_size=8), min_size=1, max_size=80))
def test_outward_model(spark, cells):
    def model(cell):
        code = re.sub(r"\s+", " ", cell.strip().upper())
        if not code:
            return None
        if " " in code:
            return code.split(" ")[0]
        found = re.match(r"[A-Z]{1,2}\d[A-Z\d]?", code)
        return found.group(0) if found else code[:4]

    assert apply(spark, text.outward_postcode, cells) == [model(c) for c in cells]


@FEW
@given(st.lists(st.tuples(st.integers(0, 99), st.integers(0, 59), st.integers(0, 59)), min_size=1, max_size=40))
def test_duration_model(spark, clocks):
    got = apply(spark, dates.duration_hours, [f"{h}:{m:02d}:{s:02d}" for h, m, s in clocks])
    assert all(math.isclose(g, h + m / 60 + s / 3600, abs_tol=1e-9) for g, (h, m, s) in zip(got, clocks))


@pytest.mark.parametrize("cell,want", [
    ("2024/03/05", "2024-03-05 00:00:00"), ("05/03/24", "2024-03-05 00:00:00"), ("5 March 2024", "2024-03-05 00:00:00"),
    ("Mar 5, 2024", "2024-03-05 00:00:00"), ("20240305", "2024-03-05 00:00:00"), ("05/03/2024 2:30 PM", "2024-03-05 14:30:00"),
    ("5-Mar-2024", "2024-03-05 00:00:00"), ("march 5th 2024 12:05 am", "2024-03-05 00:05:00"), ("2024-03-05T14:30:15", "2024-03-05 14:30:15"),
    ("05.03.2024 07:08", "2024-03-05 07:08:00"), ("05/03/99", "1999-03-05 00:00:00"), ("2024-3-5 9:07:01.5", "2024-03-05 09:07:01.5"),
    ("31/02/2024", None), ("0000-00-00", None), ("Foo 5, 2024", None), ("5 Marvel 2024 x", None), ("12", None), ("2024", None), ("NaT", None), ("", None),
])
def test_date_spellings(spark, cell, want):
    got = spark.range(1).select(dates.parse_datetime(F.lit(cell)).cast("string")).first()[0]
    assert got == want


@pytest.mark.parametrize("cell", [
    "JOB-000123", "Customer#000000001", "N12 3AA", "1-URGENT", "12:30:00", "£123.45", "Supplier#1|Supplier#2",
])
def test_text_that_begins_like_no_date_is_not_read_further(cell):
    assert not re.match(dates._BEGINS, cell)


@pytest.mark.parametrize("cell", [
    "2024-1-2", "2024/01/02T10:00", "20240102", "20240102 9am", "1.2.2024", "01-02-70", "1st January 2024", "2-Feb-2024", "Mar 3rd, 2024", "march-3-2024 2:30 PM",
])
def test_every_kind_of_date_begins_like_one(spark, cell):
    assert re.match(dates._BEGINS, cell)
    assert spark.range(1).select(dates.parse_datetime(F.lit(cell))).first()[0] is not None
