"""Delimited text whose cells hold line breaks, read by many tasks.

Whether a line begins a record depends on whether a quoted cell is open before it. So a line is a
step of an automaton with two states (outside a quoted cell, inside one). Steps can be composed:
a first pass reduces every split of a file to where it leads from either state, the states at the
starts of the splits follow from these, and in a second pass every split cuts its own records.
The lines before the first record of a split belong to the record that is open at the end of an
earlier one; only these pieces are shuffled.

A quote opens a cell only at its start, and a doubled quote inside is part of the cell, so lone
quotes inside plain cells change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'  # an opening quote and all up to the closing one
_ENDS = "file long, block long, from_outside boolean, from_inside boolean"
_PIECES = "file long, block long, part int, header boolean, text string"
_WHOLE, _HEAD, _TAIL = 0, 1, 2


def _steps(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a cell is open after a line, if none was open before it and if one was."""
    field = f'(?:{_QUOTED}"[^{sep}]*+|[^"{sep}][^{sep}]*+|)'
    rest = rf"(?:{field}[{sep}])*+{_QUOTED}\z"
    quoted = F.contains(line, F.lit('"'))
    stays = line.rlike(r'^[^"]*+(?:""[^"]*+)*+\z')
    reopens = line.rlike(rf'^[^"]*+(?:""[^"]*+)*+"[^{sep}]*+[{sep}]{rest}')
    return quoted & line.rlike(f"^{rest}"), ~quoted | stays | reopens


def text_lines(spark: SparkSession, path: str, sep: str, encoding: str = "UTF-8") -> DataFrame:
    """(line, file, block, out, inside): the lines of every split, in order within a partition."""
    raw = spark.read.option("lineSep", "\n").text(path)
    line = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    lines = raw.select(line.alias("line"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    out, inside = _steps(F.col("line"), sep)
    return lines.select("line", "file", "block", F.coalesce(out, F.lit(False)).alias("out"), F.coalesce(inside, F.lit(True)).alias("inside"))


def opens_cells(lines: DataFrame) -> bool:
    """Does any line leave a quoted cell open? Read up to the first such line."""
    return not lines.where("out").isEmpty()


def _after(out: np.ndarray, inside: np.ndarray, state: bool) -> np.ndarray:
    """The state after every line, from the state before the first."""
    fixed = out == inside  # such a line decides the state whatever it was
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(out)), -1))
    flips = np.cumsum(out & ~inside)
    base = np.where(last >= 0, out[last], state)
    return base ^ ((flips - np.where(last >= 0, flips[last], 0)) % 2 == 1)


def _runs(batch: pa.RecordBatch, file: int, block: int) -> Iterator[tuple[int, int, slice]]:
    """The stretches of a batch that lie in one split."""
    files, blocks = batch.column(file).to_numpy(), batch.column(block).to_numpy()
    cuts = np.flatnonzero((np.diff(files) != 0) | (np.diff(blocks) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(files)]):
        if b > a:
            yield int(files[a]), int(blocks[a]), slice(int(a), int(b))


def _split_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where every split leads from either state. A split may come in several batches."""
    found: dict[tuple[int, int], list[bool]] = {}
    for batch in batches:
        out, inside = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        for file, block, rows in _runs(batch, 0, 1):
            ends = found.setdefault((file, block), [False, True])
            for i in (0, 1):
                ends[i] = bool(_after(out[rows], inside[rows], ends[i])[-1])
    if found:
        columns = list(zip(*[(*split, *ends) for split, ends in found.items()]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.bool_()), pa.array(columns[3], pa.bool_())],
            names=["file", "block", "from_outside", "from_inside"])


def open_splits(lines: DataFrame) -> set[tuple[int, int]]:
    """The splits at whose start a cell is open. One row per split with quotes reaches the driver,
    which holds the list of splits anyway."""
    ends = lines.where(F.contains("line", F.lit('"'))).select("file", "block", "out", "inside").mapInArrow(_split_ends, _ENDS)
    opened: set[tuple[int, int]] = set()
    every = {(r["file"], r["block"]) for r in lines.select("file", "block").distinct().collect()}
    leads = {(r["file"], r["block"]): (r["from_outside"], r["from_inside"]) for r in ends.collect()}
    state, before = False, None
    for file, block in sorted(every):
        state = state and file == before
        if state:
            opened.add((file, block))
        state, before = leads.get((file, block), (False, True))[state], file
    return opened


class _Cutter:
    """Cuts the records of one split, a stretch of lines at a time."""

    def __init__(self, opened: bool, first: bool) -> None:
        self.state, self.seeks_header = opened, first  # the first record of a file is its header
        self.part, self.lines = (_HEAD if opened else _TAIL), []

    def cut(self, lines: pa.Array, out: np.ndarray, inside: np.ndarray) -> tuple[pa.Array, np.ndarray, str | None]:
        """The records that end in a stretch, in order, which of them is the header, and the end
        of the record that was open at the start of the split, if it ends here."""
        after = _after(out, inside, self.state)
        before = np.r_[self.state, after[:-1]]
        alone = np.flatnonzero(~before & ~after)
        texts, places, head, start = [], [], None, -1
        for i in np.flatnonzero(before | after).tolist():
            start = i if not before[i] else start
            self.lines.append(lines[i].as_py())
            if not after[i]:
                if self.part == _HEAD:
                    head = self._joined()
                else:
                    places.append(start)
                    texts.append(self._joined())
        self.state = bool(after[-1])
        ordered = lines.take(pa.array(alone))
        if texts:
            ordered = pa.concat_arrays([ordered, pa.array(texts, pa.string())]).take(pa.array(np.argsort(np.r_[alone, places], kind="stable")))
        header = np.zeros(len(ordered), bool)
        if self.seeks_header:
            filled = next((i for i in range(len(ordered)) if ordered[i].as_py().strip("\r\ufeff")), None)
            if filled is not None:
                header[filled], self.seeks_header = True, False
        return ordered, header, head

    def _joined(self) -> str:
        text, self.lines, self.part = "\n".join(self.lines), [], _TAIL
        return text


def cut_records(lines: DataFrame, opened: set[tuple[int, int]]) -> DataFrame:
    """(header, text): one row per record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, at = None, None

        def piece(part: int, header: bool, text: str) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "part": part, "header": header, "text": text}], schema=arrow)

        def rest() -> Iterator[pa.RecordBatch]:
            if cutter is not None and cutter.lines:  # a record is open at the end of the split
                yield piece(cutter.part, cutter.seeks_header, cutter._joined())

        for batch in batches:
            out, inside = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            for file, block, some in _runs(batch, 1, 2):
                if at != (file, block):
                    yield from rest()
                    cutter, at = _Cutter((file, block) in opened, block == 0), (file, block)
                texts, header, head = cutter.cut(batch.column(0).slice(some.start, some.stop - some.start), out[some], inside[some])
                if head is not None:
                    yield piece(_HEAD, False, head)
                n = len(texts)
                if n:
                    numbers = [pa.array(np.full(n, v)) for v in (file, block)]
                    yield pa.RecordBatch.from_arrays([*numbers, pa.array(np.full(n, _WHOLE, np.int32)), pa.array(header), texts], schema=arrow)
        yield from rest()

    arrow = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("part", pa.int32()), ("header", pa.bool_()), ("text", pa.string())])
    cut = lines.mapInArrow(run, _PIECES)
    # A head belongs to the nearest tail before it; a split has at most one of each.
    nearest = F.last(F.when(F.col("part") == _TAIL, F.col("block")), ignorenulls=True)
    order = W.partitionBy("file").orderBy("block", "part").rowsBetween(W.unboundedPreceding, 0)
    glued = (
        cut.where(F.col("part") != _WHOLE).withColumn("chain", nearest.over(order)).groupBy("file", "chain")
        .agg(F.sort_array(F.collect_list(F.struct("block", "text"))).alias("pieces"), F.max("header").alias("header"))
        .select("header", F.array_join(F.transform("pieces", lambda p: p["text"]), "\n").alias("text"))
    )
    return cut.where(F.col("part") == _WHOLE).select("header", "text").unionByName(glued)


def read_records(spark: SparkSession, path: str, columns: list[str], sep: str, encoding: str = "UTF-8") -> DataFrame:
    """All records of the files but their headers, as text columns."""
    lines = text_lines(spark, path, sep, encoding)
    text = F.regexp_replace("text", r"\r\z", "")
    records = cut_records(lines, open_splits(lines)).where(~F.col("header")).select(text.alias("text")).where("text <> ''")
    schema = ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
    parsed = F.from_csv("text", schema, {"sep": sep, "escape": '"', "multiLine": "true", "maxCharsPerColumn": "-1"})
    return records.select(parsed.alias("r")).select("r.*")
