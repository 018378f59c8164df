"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from jobsight.session import stage

from .text import remainder

#: Labelled rows that a classifier is fitted on, at most.
ROWS = 20_000
MODULUS = 3


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS) -> DataFrame:
    """(doc_id, text as bytes, y) of at most ``rows`` labelled documents that are not held out.

    The rows with the smallest hashes of their ids are taken, so the sample is repeatable and
    does not depend on order. Labels other than 0 and 1, and ids with two different labels,
    are left out. The ids of the sample, ``rows`` at most, are broadcast; the texts stay
    distributed and are written once.
    """
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    usable = marked.where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (remainder(F.col("doc_id"), MODULUS) != 1))
    once = usable.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_other")).where("y = _other").drop("_other")
    chosen = once.orderBy(F.xxhash64(F.lit(7), "doc_id"), "doc_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    return stage(texts.join(F.broadcast(chosen), "doc_id"), f"sample_{label}")
