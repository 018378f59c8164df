"""Exact duplicates by skew-safe combining (DataFrame operations only).

Rows are combined in three steps, and every step groups by the digest AND the full text,
so two texts with one digest never meet:

1. each task combines its own rows (the map side of the first aggregate);
2. the digests of a group are salted by doc_id, so a group that holds a third of all rows
   is merged in ``salts`` tasks, each of which gets one row per map task;
3. the salt winners of a text, at most ``salts`` rows, are combined globally.

The table of winners has a digest and no text, unless a digest has more than one text. Rows are
told their winner by a join that deals the rows of frequent digests over all tasks.

Edge cases: a null text counts as empty; the largest doc_id stays, and a null id is smaller
than any; of rows repeated with the same id and text exactly one stays; an empty table gives
an empty result; columns other than doc_id and text are not read (``duplicate_groups``) or
kept as they are, whatever their names (``keep_one_of_each``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from jobsight.session import stage

from .spread import join_one

SALTS = 16


def sha256(text: Column) -> Column:
    """Digest of a text as lowercase hex."""
    return F.sha2(text.cast("binary"), 256)


def _keyed(docs: DataFrame, digest: Callable[[Column], Column], salts: int) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), digest(text).alias("_key"),
        F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("_salt"),
    )


def _winners(keyed: DataFrame) -> DataFrame:
    """One row per text: its digest, the id that stays and the number of rows."""
    salted = keyed.groupBy("_key", "text", "_salt").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    # Dealt by the digest alone, so that the texts of one digest can be counted in place.
    return salted.repartition("_key").groupBy("_key", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size")
    )


def duplicate_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = _keyed(docs, digest, salts)
    texts = F.count(F.lit(1)).over(W.partitionBy("_key"))
    winners = stage(
        _winners(keyed).withColumn("_texts", texts)
        .select("_key", "keep_id", "group_size", F.when(F.col("_texts") > 1, F.col("text")).alias("_text")),
        "dedup_winners",
    )
    # Repeated rows of one id are counted before the join, so they can be told apart after it.
    rows = keyed.groupBy("doc_id", "_key", sha256(F.col("text")).alias("text_sha256")).agg(F.count(F.lit(1)).alias("_n"))
    alone = winners.where(F.col("_text").isNull()).drop("_text")
    found = join_one(rows, alone, "_key", "group_size", F.xxhash64("doc_id"))
    shared = winners.where(F.col("_text").isNotNull())
    if not shared.isEmpty():  # a digest with several texts: those rows are matched by text
        few = keyed.join(shared.select("_key").distinct(), "_key", "left_semi")
        told = few.groupBy("doc_id", "_key", "text").agg(F.count(F.lit(1)).alias("_n"))
        found = found.unionByName(
            told.join(shared.withColumnRenamed("_text", "text"), ["_key", "text"])
            .withColumn("text_sha256", sha256(F.col("text"))).drop("text")
        )
    first = F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy")
    return found.select("doc_id", "keep_id", "group_size", "text_sha256", first).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256",
    )


def keep_one_of_each(docs: DataFrame, digest: Callable[[Column], Column] = sha256, salts: int = SALTS) -> DataFrame:
    """The rows of ``docs`` without exact duplicates, all columns kept: the winner of a group
    travels with its whole row, so no join is needed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"], F.col("text").isNull().alias("_was_null"))
    order = F.struct(F.col("doc_id"), F.xxhash64(F.to_json(row)))  # the same row stays in every run
    keyed = docs.select(
        digest(text).alias("_key"), text.alias("_text"), F.pmod(F.xxhash64("doc_id"), F.lit(salts)).alias("_salt"),
        order.alias("_order"), row.alias("_row"),
    )
    salted = keyed.groupBy("_key", "_text", "_salt").agg(F.max_by("_row", "_order").alias("_row"), F.max("_order").alias("_order"))
    best = salted.groupBy("_key", "_text").agg(F.max_by("_row", "_order").alias("_row"))
    kept = F.when(~F.col("_row._was_null"), F.col("_text")).alias("text")
    return best.select(*[kept if c == "text" else F.col(f"_row.`{c}`") for c in docs.columns])
