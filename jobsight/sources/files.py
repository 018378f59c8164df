"""Reading and writing datasets."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from jobsight.session import path_exists
from jobsight.sources import records

# Delimiters in the order that decides ties.
DELIMITERS = ["\t", ",", ";", "|"]
TEXT_FORMATS = [".csv", ".txt", ".tsv"]
TABLE_FORMATS = {".parquet": "parquet", ".json": "json", ".orc": "orc"}


def _suffix(path: str) -> str:
    found = re.search(r"(\.[A-Za-z0-9]+)/?$", path)
    return found.group(1).lower() if found else ""


def _check_path(spark: SparkSession, path: str) -> None:
    """The path must exist and end in a known extension."""
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Dataset not found: {path}")
    known = TEXT_FORMATS + list(TABLE_FORMATS)
    if _suffix(path) not in known:
        raise ValueError(f"Unsupported dataset type {_suffix(path)}. Supported: {sorted(known)}")


def guess_delimiter(header: str) -> str:
    """The most frequent delimiter of the header line; of equal ones the first in the list."""
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d)))


def read_delimited(
    spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool | None = None
) -> DataFrame:
    """Delimited text with a header line, all columns as text.

    Only the header line is looked at to find the delimiter. Files are split between tasks, also
    where cells hold line breaks (``records``); by default the lines decide whether any does.
    UTF-16 files, and all files with ``multi_line``, are read whole, one task each.
    """
    whole = encoding.upper().startswith("UTF-16") or bool(multi_line)
    first = spark.read.option("encoding", encoding).option("multiLine", whole).option("sep", "\u0001").option(
        "maxCharsPerColumn", -1
    ).csv(path).limit(1).head()
    sep = guess_delimiter(first[0] if first and first[0] is not None else "")
    reader = (
        spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
        .option("escape", '"').option("inferSchema", False)
    )
    if not whole and multi_line is None and has_open_quotes(spark, path, sep, encoding):
        # Only the first record is read for the names.
        columns = reader.option("multiLine", True).csv(path).columns
        return records.read_records(spark, path, columns, sep, encoding)
    return reader.option("multiLine", whole).csv(path)


def has_open_quotes(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8") -> bool:
    """Does a line end inside a quoted cell? Read without splitting cells, up to the first such line."""
    return records.opens_cells(records.text_lines(spark, path, sep, encoding))


def load_dataset(spark: SparkSession, path: str, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """A dataset by its extension: delimited text, or a columnar or JSON table."""
    _check_path(spark, path)
    suffix = _suffix(path)
    if suffix in TABLE_FORMATS:
        return spark.read.format(TABLE_FORMATS[suffix]).load(path)
    return read_delimited(spark, path, encoding, multi_line)


def write_dataset(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header, or a table, by the extension; one part file per task."""
    suffix = _suffix(path)
    if suffix in TABLE_FORMATS:
        df.write.mode(mode).format(TABLE_FORMATS[suffix]).save(path)
    elif suffix in TEXT_FORMATS:
        separator = "\t" if suffix == ".tsv" else ","
        texts = df.select([F.col(c).cast("string").alias(c) for c in df.columns])
        texts.write.mode(mode).option("header", True).option("sep", separator).option("escape", '"').csv(path)
    else:
        raise ValueError(f"Unsupported dataset type {suffix}. Supported: {sorted(TEXT_FORMATS + list(TABLE_FORMATS))}")
