"""Delimited text with line breaks in cells, cut into many splits."""

from __future__ import annotations

import csv
import io
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from jobsight.sources import files, records


def cell(rng):
    kind = rng.randrange(8)
    text = "".join(rng.choice("abc é,;|\t") for _ in range(rng.randrange(12)))
    if kind < 3:
        return text
    if kind == 3:
        return f'{text}"{text}""'
    if kind == 4:
        return "\n" * rng.randrange(1, 5) + text + '"\n",' + text
    if kind == 5:
        return 'say "x\n' * rng.randrange(1, 40)
    return "" if kind == 6 else str(rng.randrange(10**6))


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("sep, line_end", [(",", "\n"), (";", "\r\n"), ("|", "\n"), ("\t", "\n")])
def test_many_splits_equal_the_whole_file(spark, small_splits, tmp_path, sep, line_end):
    rng = random.Random(sep)
    for name in ("x.csv", "y.csv"):
        out = io.StringIO()
        writer = csv.writer(out, delimiter=sep, lineterminator=line_end)
        writer.writerow(["id", "first note", "second"])
        for i in range(2000):
            writer.writerow([f"{name}{i}", cell(rng), cell(rng)])
        (tmp_path / name).write_bytes(out.getvalue().encode())
    path = str(tmp_path / "*.csv")
    whole = files.read_delimited(spark, path, multi_line=True)
    split = files.read_delimited(spark, path)
    assert split.columns == whole.columns
    assert split.rdd.getNumPartitions() > 100 and whole.rdd.getNumPartitions() <= 2
    assert Counter(map(tuple, split.collect())) == Counter(map(tuple, whole.collect()))


def test_a_cell_over_many_splits(spark, small_splits, tmp_path):
    long = "\n".join(f"line {i} \"\"{i}\"\"" for i in range(2000))
    (tmp_path / "x.csv").write_text(f'a,"b\nc"\n1,"{long}"\n2,"{long}"\n3,x\n4,"open\nto the end')
    got = files.read_delimited(spark, str(tmp_path / "x.csv"))
    assert got.columns == ["a", "b\nc"]
    cell = long.replace('""', '"')
    assert sorted(map(tuple, got.collect())) == [("1", cell), ("2", cell), ("3", "x"), ("4", "open\nto the end")]


def test_lone_quotes_in_plain_cells(spark, tmp_path):
    """They open nothing, with or without line breaks elsewhere."""
    (tmp_path / "inch.csv").write_text('a,b\n5" pipe,1\n6" pipe,2\n')
    assert not files.has_open_quotes(spark, str(tmp_path / "inch.csv"))
    (tmp_path / "both.csv").write_text('a,b\n5" pipe,"1\n1"\n6" pipe,2\n"x"\n')
    got = files.read_delimited(spark, str(tmp_path / "both.csv")).collect()
    assert sorted(map(tuple, got)) == [('5" pipe', "1\n1"), ('6" pipe', "2"), ("x", None)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.booleans()), min_size=1, max_size=30), st.booleans(), st.integers(1, 30))
def test_steps_compose(steps, state, cut):
    out, inside = (np.array(x) for x in zip(*steps))
    want, now = [], state
    for a, b in steps:
        now = b if now else a
        want.append(now)
    assert records._after(out, inside, state).tolist() == want
    if cut < len(steps):
        middle = bool(records._after(out[:cut], inside[:cut], state)[-1])
        assert bool(records._after(out[cut:], inside[cut:], middle)[-1]) == want[-1]
