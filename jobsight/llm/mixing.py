"""Mixing sources to target weights by pivotal dependent rounding (DataFrame operations only).

Every source gets a target number of words; a document of the source is taken
``target / source size`` times in expectation. The whole part is taken as it is; the
fractional parts are rounded by the pivotal method: two documents meet, mass moves from one
to the other at random, weighted by their sizes so that the words taken do not change,
until one of the two is 0 or 1. That one is decided and the other meets the next. A source
is thus rounded to its target up to one document, and every document keeps its expectation.

The pairing is a reduction tree: the leaves are blocks of about ``FANIN`` documents of one
source, each folds to decided documents and at most one undecided, and these residuals meet
in blocks of the next level. A source of any size is spread over all tasks.

Edge cases: a null text has size 0 and a null source is a source of its own, the last;
empty documents and sources of size 0 take nothing; rows repeated with one id, source and
size are rounded together and the copies dealt to them in turn; an empty table gives an
empty result. Random numbers are hashes of ids, so reruns agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from jobsight.operators.ordered import number_rows
from jobsight.session import stage

from .text import word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: A document is taken at most so many times.
MOST = 2
FANIN = 64
SEED = 20


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, rows, place, target) from rows of (source, size, n).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all
    sizes; a target stops at ``most`` times the source's size and the excess is shared again
    by weight until none is above. Each round is one aggregate over the sources.
    """
    per_source = sizes.groupBy("source").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("items")
    )
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    placed = number_rows(per_source, [F.col("source").asc_nulls_last()], "place").withColumn("weight", weight)
    sources = stage(placed, "mix_sources")
    cap = F.col("source_size") * most
    goal = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = (cap < F.col("weight") * level) if capped >= 0 else F.lit(False)
        at_cap, left, n = sources.agg(
            F.sum(F.when(full, cap).otherwise(0)), F.sum(F.when(full, 0).otherwise(F.col("weight"))), F.sum(full.cast("long"))
        ).first()
        if n is None or n == capped or not left:
            break
        level, capped = (goal - at_cap) / left, n
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(float(level))))


def _uniform(*parts: Column) -> Column:
    return F.xxhash64(*parts).bitwiseAND((1 << 53) - 1) / float(1 << 53)


def _fold(items: Column, seed: int) -> Column:
    """Pivotal rounding of an array of (item, weight, x) with 0 < x < 1, one after the other.

    Gives struct(held, done): the undecided item, if any, and the items decided, with x 0 or 1.
    """
    def step(acc: Column, b: Column) -> Column:
        a = acc["held"]
        ratio = b["weight"] / a["weight"]
        # Mass, in units of a, that can move to a and from a until one of the two is integral.
        up = F.least(1 - a["x"], b["x"] * ratio)
        down = F.least(a["x"], (1 - b["x"]) * ratio)
        rises = _uniform(F.lit(seed), a["item"], b["item"]) * (up + down) < down
        a_ends = F.when(rises, (1 - a["x"]) <= b["x"] * ratio).otherwise(a["x"] <= (1 - b["x"]) * ratio)
        moved = F.when(rises, up).otherwise(-down)
        end_a, end_b = F.when(rises, 1.0).otherwise(0.0), F.when(rises, 0.0).otherwise(1.0)
        rest_a = F.least(F.greatest(a["x"] + moved, F.lit(0.0)), F.lit(1.0))
        rest_b = F.least(F.greatest(b["x"] - moved / ratio, F.lit(0.0)), F.lit(1.0))
        made = lambda i, x: F.struct(i["item"].alias("item"), i["weight"].alias("weight"), x.alias("x"))
        done = F.when(a_ends, made(a, end_a)).otherwise(made(b, end_b))
        rest = F.when(a_ends, made(b, rest_b)).otherwise(made(a, rest_a))
        whole = (rest["x"] <= 0.0) | (rest["x"] >= 1.0)
        return F.when(
            a.isNull(), F.struct(made(b, b["x"]).alias("held"), acc["done"].alias("done"))
        ).when(
            whole, F.struct(F.lit(None).cast(kind).alias("held"), F.concat(acc["done"], F.array(done, rest)).alias("done"))
        ).otherwise(F.struct(rest.alias("held"), F.concat(acc["done"], F.array(done)).alias("done")))

    kind = "struct<item:bigint,weight:double,x:double>"
    start = F.from_json(F.lit('{"done": []}'), f"struct<held:{kind},done:array<{kind}>>")
    return F.aggregate(items, start, step)


def pivotal_rounding(items: DataFrame, largest: int, seed: int = SEED, fanin: int = FANIN) -> DataFrame:
    """(place, item, x 0 or 1) for items (place, item, weight, x, block): ``place`` is the group
    whose weighted sum is kept, ``block`` the leaf, below ``largest``, where the item starts."""
    decided, level, blocks = [], 0, max(1, largest)
    while True:
        # Largest first: the small ones that follow leave little undecided at the end.
        entry = F.struct(F.col("weight"), F.col("item"), F.col("x"))
        folded = items.groupBy("place", "block").agg(F.sort_array(F.collect_list(entry), asc=False).alias("items"))
        folded = stage(folded.select("place", "block", _fold(F.col("items"), seed + level).alias("f")), "pivotal")
        decided.append(folded.select("place", F.inline("f.done")).select("place", "item", "x"))
        items = folded.where("f.held is not null").select("place", "f.held.*", F.floor(F.col("block") / fanin).alias("block"))
        level += 1
        if blocks == 1:
            break
        blocks = math.ceil(blocks / fanin)
    # The last of a source has nothing to meet: it is taken with the probability it holds.
    lot = (_uniform(F.lit(seed + level), F.col("item"), F.col("place")) < F.col("x")).cast("double")
    out = items.select("place", "item", lot.alias("x"))
    for part in decided:
        out = out.unionByName(part)
    return out


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST,
             seed: int = SEED, fanin: int = FANIN) -> DataFrame:
    """One row per (source, doc_id, size): n rows of it, source_size, target and the copies taken of all n."""
    sized = docs.select(
        F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size")
    )
    items = stage(sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("n")), "mix_items")
    targets = source_targets(items, weights, share, most)
    most_items = targets.agg(F.max("items")).first()[0] or 0
    joined = items.join(targets.select(F.col("source").alias("_source"), "place", "source_size", "target", "items"),
                        F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = F.when(F.col("size") > 0, each * F.col("n")).otherwise(0.0)
    # A number names an item in the tree: rows of one id differ in size or source.
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    leaf = F.pmod(key, F.ceil(F.col("items") / fanin).cast("long"))
    ready = joined.withColumn("_wanted", wanted).withColumn("_whole", F.floor("_wanted").cast("long")).withColumn("_item", key)
    rest = ready.select("place", F.col("_item").alias("item"), F.col("size").cast("double").alias("weight"),
                        (F.col("_wanted") - F.col("_whole")).alias("x"), leaf.alias("block")).where("x > 0")
    rounded = pivotal_rounding(rest, math.ceil(most_items / fanin), seed, fanin).groupBy("place", "item").agg(F.max("x").alias("_x"))
    return ready.join(rounded.withColumnRenamed("item", "_item"), ["place", "_item"], "left").select(
        "source", "doc_id", "size", "n", "source_size", "target",
        (F.col("_whole") + F.coalesce(F.col("_x"), F.lit(0.0)).cast("long")).alias("copies"),
    )


def _dealt(copies: Column, n: Column, place: Column) -> Column:
    """Copies of the row at ``place`` (from 1) of n equal rows that share ``copies``."""
    return (F.floor(copies / n) + (place <= copies % n).cast("long")).cast("long")


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies and the words taken."""
    rows = mix_plan(docs, **how).withColumn("_place", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = _dealt(F.col("copies"), F.col("n"), F.col("_place"))
    return rows.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mixed_rows(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every row of ``docs`` as many times as it is taken, all columns kept."""
    from pyspark.sql import Window as W

    plan = stage(mix_plan(docs, **how).where("copies > 0"), "mix_plan")
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("source").cast("string").alias("source"),
        F.col("doc_id").cast("long").alias("doc_id"), word_count(F.col("text")).alias("size"),
    )
    same = F.col("d.doc_id").eqNullSafe(F.col("p.doc_id")) & F.col("d.source").eqNullSafe(F.col("p.source")) & (F.col("d.size") == F.col("p.size"))

    def joined(some: DataFrame) -> DataFrame:
        # The plan has a row per document: it is never broadcast, at no size.
        return rows.alias("d").join(some.hint("merge").alias("p"), same).select("d._row", "d.doc_id", "d.source", "d.size", "n", "copies")

    found = joined(plan.where("n = 1")).select("_row", "copies")
    many = plan.where("n > 1")
    if not many.isEmpty():  # repeated rows are numbered, so that the copies can be dealt to them
        at = F.row_number().over(W.partitionBy("source", "doc_id", "size").orderBy("size"))
        found = found.unionByName(joined(many).select("_row", _dealt(F.col("copies"), F.col("n"), at).alias("copies")))
    taken = found.where("copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return taken.select(*[F.col(f"_row.`{c}`") for c in docs.columns])
