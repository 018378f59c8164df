"""Join of rows with a table of one row per key, where one key may hold a third of the rows.

Keys with at least a thousandth of all rows, of which there can be no more than a thousand
whatever the size of the table, are broadcast; their rows then meet no other key and are dealt
by a hash of their own. All other keys are joined by a shuffle on the key.

Edge cases: a null key matches nothing; a key without a partner is left out; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A key is broadcast if it has at least this part of all rows, so this is the most there are.
PARTS = 1000


def join_one(rows: DataFrame, ones: DataFrame, key: str, n: str, spread: Column, parts: int = PARTS) -> DataFrame:
    """Inner join of ``rows`` with ``ones``, a stored table of one row per ``key`` whose column ``n`` counts
    the rows of its key; ``spread`` is a hash by which the rows of a frequent key are dealt."""
    told = F.struct(*[F.col(c) for c in ones.columns if c != key])
    least = (ones.agg(F.sum(F.col(n))).first()[0] or 0) / parts
    frequent = ones.where(F.col(n) >= least).select(key, told.alias("_frequent"))
    # The hint is for at most ``parts`` rows.
    marked = rows.join(F.broadcast(frequent), key, "left")
    marked = marked.withColumn("_spread", F.when(F.col("_frequent").isNull(), F.lit(0)).otherwise(spread).cast("long"))
    # Zero for every row, but no literal: the optimizer would take a literal out of the join's keys.
    zero = F.least(F.col(n).cast("long"), F.lit(0)).alias("_spread")
    rare = ones.where(F.col(n) < least).select(key, zero, told.alias("_rare"))
    found = marked.join(rare, [key, "_spread"], "left").withColumn("_one", F.coalesce("_frequent", "_rare"))
    return found.where(F.col("_one").isNotNull()).select(*[F.col(f"`{c}`") for c in rows.columns], "_one.*")
