"""Staged tables go with their run; runs of others stay."""

from __future__ import annotations

import json
import os
import time

import pytest

from jobsight import __main__ as command
from jobsight.session import OWNER, RUN, SHARED, run_folder, scratch_path, shared_dir, stage


@pytest.fixture
def own(spark, tmp_path):
    """A session of its own with a shared folder of its own."""
    session = spark.newSession()
    session.conf.set(SHARED, str(tmp_path))
    return session


def runs(session):
    folder = f"{shared_dir(session)}/jobsight"
    return sorted(n for n in os.listdir(folder) if n.startswith("run-")) if os.path.isdir(folder) else []


def test_staged_tables_go_with_the_run(own):
    outside = stage(own.range(3), "outside")
    with run_folder(own) as path:
        inside = stage(own.range(5), "inside")
        assert inside.count() == 5 and all(path in f for f in inside.inputFiles())
        assert len(runs(own)) == 1
    assert runs(own) == [] and own.conf.get(RUN, None) is None
    assert outside.count() == 3  # what no run has staged stays
    assert "/run-" not in scratch_path(own, "later")


def test_nothing_stays_after_an_error(own):
    with pytest.raises(ValueError, match="broken"):
        with run_folder(own):
            stage(own.range(5), "inside")
            raise ValueError("broken")
    assert runs(own) == [] and own.conf.get(RUN, None) is None


def test_a_run_inside_another_is_a_part_of_it(own):
    with run_folder(own) as outer:
        kept = stage(own.range(4), "outer")
        with run_folder(own) as inner:
            assert inner.startswith(f"{outer}/")
            stage(own.range(2), "inner")
        assert not os.path.exists(inner) and own.conf.get(RUN) == outer
        assert kept.count() == 4
    assert runs(own) == []


def left_behind(session, name, until):
    folder = f"{shared_dir(session)}/jobsight/run-{name}"
    os.makedirs(f"{folder}/table-1")
    if until is not None:
        with open(f"{folder}/{OWNER}", "w") as record:
            json.dump({"lease": 60, "until": until}, record)


def test_a_later_run_removes_the_abandoned_alone(own):
    left_behind(own, "dead", time.time() - 1)
    left_behind(own, "alive", time.time() + 3600)
    left_behind(own, "unsigned", None)
    with run_folder(own):
        assert "run-dead" not in runs(own)
    assert runs(own) == ["run-alive", "run-unsigned"]


def test_runs_side_by_side(own):
    other = own.newSession()
    other.conf.set(SHARED, shared_dir(own))
    with run_folder(own):
        mine = stage(own.range(7), "mine")
        with run_folder(other) as theirs:
            stage(other.range(2), "theirs")
        assert not os.path.exists(theirs) and mine.count() == 7


def test_staging_renews_the_lease(own):
    with run_folder(own, lease=1000) as outer, run_folder(own, lease=1000) as inner:
        for path in (outer, inner):
            with open(f"{path}/{OWNER}", "w") as record:
                json.dump({"lease": 1000, "until": 5.0}, record)
        stage(own.range(1), "table")
        for path in (outer, inner):
            assert json.load(open(f"{path}/{OWNER}"))["until"] > time.time() + 900


def test_steps_of_the_command_line_leave_results_alone(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("Job No,Status\n1,Done\n1,Done\n2,\n")
    before = runs(spark)
    command.main(["clean", str(tmp_path / "raw.csv"), str(tmp_path / "clean.parquet"), str(tmp_path / "log.parquet")])
    assert spark.read.parquet(str(tmp_path / "clean.parquet")).count() == 2
    assert spark.read.parquet(str(tmp_path / "log.parquet")).count() > 0
    assert runs(spark) == before
