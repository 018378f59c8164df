"""Reading whole texts in tasks and in column expressions.

Words are the runs of characters other than space and \\t to \\r; ``bytes.split()`` gives
exactly these on UTF-8, so tasks work on binary columns and never decode what they don't need.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x20\x09-\x0D]+"
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
#: Bytes of a text that are split into words at a time; a longer text is read in pieces.
PIECE = 1 << 20


def word_count(text: Column) -> Column:
    """Number of words as a long; null counts as empty."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether a row is held out of learning (remainder 1); a null id is not."""
    return F.coalesce(remainder(doc_id, modulus) == 1, F.lit(False))


def whole_texts(docs: DataFrame, *more: Column) -> DataFrame:
    """(doc_id, text as UTF-8 bytes, more): null texts as empty, other columns dropped."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"), *more,
    )


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """Cut a text at white space into runs of about ``size`` bytes; no word is cut."""
    start = 0
    while start < len(text):
        end = start + size
        if end < len(text):
            space = _SPACE.search(text, end)
            end = space.start() if space else len(text)
        yield text[start:end]
        start = end


def map_rows(df: DataFrame, per_batch: Callable[[list[dict]], list[dict]], schema: str,
             rows: int = 2048) -> DataFrame:
    """``mapInArrow`` with rows as dicts, at most ``rows`` at a time, so that memory is
    bounded by that many texts whatever the size of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows):
                out = per_batch(batch.slice(start, rows).to_pylist())
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)

    arrow = arrow_schema(df, schema)
    return df.mapInArrow(run, schema)


def arrow_schema(df: DataFrame, schema: str) -> pa.Schema:
    """The Arrow form of a schema written in Spark's DDL."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))
