"""Ordered statistics over groups of any size: running totals, exact quantiles,
sums over a value band and exact k-smallest picks.

A window over a whole group would sort that group in one task, which breaks when a
single key holds a large part of the table. All operators here work in two levels:

1. rows are first reduced to one per (group, value), combined on the map side;
2. values fall into order-preserving bins of relative width ``1 / BINS_PER_E``.
   Totals per (group, bin) give each bin its start, in a window of a few thousand small
   rows per group however large the table is, and only the distinct values of one
   (group, bin) are ever sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from jobsight.session import stage

BINS_PER_E = 2 ** 8
# A group of up to this many rows is sorted in one task without trouble.
SMALL_GROUP = 200_000
_ALL = "_all_rows"


def value_bin(value: Column) -> Column:
    """Bin number that never decreases with the value (sign-aware logarithmic steps)."""
    size = F.floor(F.least(F.log1p(F.abs(value)), F.lit(800.0)) * BINS_PER_E)
    return F.when(value < 0, -size - 1).otherwise(size)


def _bin_starts(binned: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Per (keys, bin): the total of each measure in all lower bins of the group."""
    totals = binned.groupBy(*keys, "_bin").agg(*[F.sum(m).alias(m) for m in measures])
    below = W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *keys, "_bin", *[F.coalesce(F.sum(m).over(below), F.lit(0)).alias(f"_start_{m}") for m in measures]
    )


def _keyed(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Give a whole-table computation one constant key, so that one code path serves both."""
    return (df, list(keys)) if keys else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def running_totals(df: DataFrame, keys: list[str], value: str, measures: list[str]) -> DataFrame:
    """One row per (keys, value): the sum of each measure, and ``below_<m>``, its sum over
    all smaller values of the group. Keys and value must not be null."""
    df, keys = _keyed(df, keys)
    points = (
        df.groupBy(*keys, value)
        .agg(*[F.sum(m).alias(m) for m in measures])
        .withColumn("_bin", value_bin(F.col(value).cast("double")))
    )
    starts = _bin_starts(points, keys, measures)
    below = W.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    inside = points.select(
        "*", *[F.coalesce(F.sum(m).over(below), F.lit(0)).alias(f"_in_{m}") for m in measures]
    )
    return inside.join(starts, [*keys, "_bin"]).select(
        *[k for k in keys if k != _ALL],
        value,
        *measures,
        *[(F.col(f"_start_{m}") + F.col(f"_in_{m}")).alias(f"below_{m}") for m in measures],
    )


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], weight: str | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per group.

    ``quantiles`` maps output names to probabilities. Nulls do not count; a group
    without values gives no row. Only the bins that hold a wanted rank are sorted.
    A row counts as often as its whole-number ``weight`` says.
    """
    df, keys = _keyed(df, keys)
    points = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_value"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
        .withColumn("_bin", value_bin(F.col("_value")))
    )
    in_group = W.partitionBy(*keys)
    bins = (
        points.groupBy(*keys, "_bin")
        .agg(F.sum("_n").alias("_bin_n"))
        .withColumn("_rows", F.sum("_bin_n").over(in_group))
        .withColumn(
            "_start",
            F.coalesce(
                F.sum("_bin_n").over(in_group.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
    )
    position = {name: (F.col("_rows") - 1) * F.lit(float(p)) for name, p in quantiles.items()}
    ranks = F.array(*[f(pos) for pos in position.values() for f in (F.floor, F.ceil)])
    wanted = bins.where(
        F.exists(ranks, lambda r: (r >= F.col("_start")) & (r < F.col("_start") + F.col("_bin_n")))
    )
    before = W.partitionBy(*keys, "_bin").orderBy("_value").rowsBetween(W.unboundedPreceding, -1)
    placed = points.join(wanted.drop("_bin_n"), [*keys, "_bin"]).withColumn(
        "_first", F.col("_start") + F.coalesce(F.sum("_n").over(before), F.lit(0))
    )

    def at(rank: Column) -> Column:
        hit = (rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_n"))
        return F.max(F.when(hit, F.col("_value")))

    picked = placed.groupBy(*keys).agg(
        F.max("_rows").alias("_rows"),
        *[at(F.floor(pos)).alias(f"_lo_{name}") for name, pos in position.items()],
        *[at(F.ceil(pos)).alias(f"_hi_{name}") for name, pos in position.items()],
    )
    results = []
    for name, pos in position.items():
        part = pos - F.floor(pos)
        low, high = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        results.append((low * (1 - part) + high * part).alias(name))
    return picked.select(*[k for k in keys if k != _ALL], *results)


def quantiles_of_sized(
    df: DataFrame, sizes: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], weight: str
) -> DataFrame:
    """``exact_quantiles`` where a stored table ``sizes`` (keys, ``_rows``, ``_points``) has the weight and the
    number of the rows of every group that has a value. Groups of up to ``SMALL_GROUP`` rows are sorted whole, in one
    shuffle; larger ones bin by bin."""
    number = F.col(value).cast("double")
    points = df.where(F.col(value).isNotNull()).select(
        *keys, F.when(number == 0, 0.0).otherwise(number).alias("_value"), F.col(weight).alias("_n")  # one zero, as in a grouping
    )
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_value").rowsBetween(W.unboundedPreceding, 0))
    placed = points.join(sizes.where(F.col("_points") <= SMALL_GROUP).select(*keys, "_rows"), keys).withColumn("_upto", upto)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_upto") - F.col("_n")) & (rank < F.col("_upto")), F.col("_value")))

    def between(p: float) -> Column:
        pos = (F.col("_rows") - 1) * F.lit(float(p))
        part = F.max(pos - F.floor(pos))
        return at(F.floor(pos)) * (1 - part) + at(F.ceil(pos)) * part

    result = placed.groupBy(*keys).agg(*[between(p).alias(name) for name, p in quantiles.items()])
    large = sizes.where(F.col("_points") > SMALL_GROUP).select(*keys)
    if large.isEmpty():
        return result
    return result.unionByName(exact_quantiles(df.join(large, keys, "left_semi"), keys, value, quantiles, weight))


def _salted(probes: DataFrame, keys: list[str], probe_id: list[str]) -> DataFrame:
    """Spread the probes of a group that has more than ``SMALL_GROUP`` of them over that many salts."""
    crowded = (
        probes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_asked"))
        .where(F.col("_asked") > SMALL_GROUP)
        .select(*keys, F.ceil(F.col("_asked") / SMALL_GROUP).alias("_salts"))
    )
    crowded = stage(crowded, "crowded_groups")  # few rows: written, so that probes need no shuffle to be told
    salt = F.pmod(F.xxhash64(*probe_id), F.coalesce("_salts", F.lit(1)))
    return probes.join(crowded, keys, "left").withColumn("_salt", salt).drop("_salts")


def band_edges(
    facts: DataFrame,
    probes: DataFrame,
    keys: list[str],
    value: str,
    low: str,
    high: str,
    measures: list[str],
    probe_id: list[str],
    group_rows: str,
) -> DataFrame:
    """Two rows per probe, whose measures add up to the sums over the facts of its group with
    a value in ``[low, high]``, both ends included (J5).

    The band is a difference of two running totals, so the cost is a sort of facts and
    probes together: no pair of a probe and a fact is ever formed. Groups go by two numbers,
    128 bits of hashes of their keys, so neither side is joined with a table of names and rows
    are dealt and sorted by numbers only; facts of groups nobody asks for are dropped before the
    sort. ``group_rows`` is a probe column with the number of fact rows of its group: groups up
    to ``SMALL_GROUP`` are sorted whole, larger ones bin by bin. Where many probes ask for one
    small group, its facts are repeated for every ``SMALL_GROUP`` probes, so hot groups spread
    over tasks on both sides. Probes must be unique by ``probe_id``; those with an empty band
    (low above high) or a null key give no row. Probes are read several times, so pass a staged
    table.
    """
    # At equal values a low edge sorts before the facts and a high edge after them.
    edge = lambda at, side: F.struct(F.col(at).cast("double").alias("_at"), F.lit(side).alias("_side"))
    zero = [F.lit(0).cast("long").alias(m) for m in measures]
    kinds = dict(probes.dtypes)

    def named(df: DataFrame) -> DataFrame:
        alike = [F.col(k).cast(kinds[k]) for k in keys]
        known = df.where(" and ".join(f"`{k}` is not null" for k in keys))
        return known.withColumns({"_g1": F.xxhash64(*alike), "_g2": F.xxhash64(F.lit(1), *alike)})

    def line_for(asked: DataFrame, group: list[str]) -> DataFrame:
        groups = stage(asked.select(*group).distinct(), "band_groups")  # written, so that its size is known
        marks = (
            named(facts.where(F.col(value).isNotNull()))
            .select("_g1", "_g2", F.col(value).cast("double").alias("_at"), F.lit(1).alias("_side"), *measures)
            .join(groups, ["_g1", "_g2"])
        )
        edges = asked.select(*group, *probe_id, F.inline(F.array(edge(low, 0), edge(high, 2)))).select("*", *zero)
        return marks.unionByName(edges, allowMissingColumns=True)

    def upto(group: list[str], m: str) -> Column:
        window = W.partitionBy(*group).orderBy("_at", "_side").rowsBetween(W.unboundedPreceding, 0)
        return F.sum(m).over(window).alias(f"_to_{m}")

    valid = named(probes.where(F.col(low) <= F.col(high)))
    whole = valid.where(F.col(group_rows) <= SMALL_GROUP)
    numbers = group = ["_g1", "_g2"]
    if probes.count() > SMALL_GROUP:
        whole, group = _salted(whole, numbers, probe_id), [*numbers, "_salt"]
    read = line_for(whole, group).select("*", *[upto(group, m) for m in measures]).where("_side != 1")
    wide = valid.where(F.col(group_rows) > SMALL_GROUP)
    if not wide.isEmpty():
        line = line_for(wide, numbers).withColumn("_bin", value_bin(F.col("_at")))
        starts = _bin_starts(line, numbers, measures)
        binned = (
            line.select("*", *[upto([*numbers, "_bin"], m) for m in measures])
            .where("_side != 1")
            .join(starts, [*numbers, "_bin"])
            .withColumns({f"_to_{m}": F.col(f"_start_{m}") + F.col(f"_to_{m}") for m in measures})
        )
        read = read.select(*probe_id, "_side", *[f"_to_{m}" for m in measures]).unionByName(binned.select(*probe_id, "_side", *[f"_to_{m}" for m in measures]))
    sign = F.col("_side") - 1
    return read.select(*probe_id, *[(sign * F.col(f"_to_{m}")).alias(m) for m in measures])


def band_totals(facts: DataFrame, probes: DataFrame, keys: list[str], value: str, low: str, high: str,
                measures: list[str], probe_id: list[str], group_rows: str) -> DataFrame:
    """One row per probe: the sums that ``band_edges`` adds up to."""
    edges = band_edges(facts, probes, keys, value, low, high, measures, probe_id, group_rows)
    return edges.groupBy(*probe_id).agg(*[F.sum(m).alias(m) for m in measures])


def number_rows(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add the running number 1..n of every row in the given order.

    Rows are range-partitioned by the order and written once, so every part is a
    contiguous piece of it with a fixed number; a part's start is the size of the parts
    before it. No task sorts more than one part. The order must be total.
    """
    parts = stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered_parts")
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # over one row per part
    starts = (
        parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
        .select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    )
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return (
        parts.withColumn("_place", place).join(starts, "_part")
        .withColumn(name, F.col("_start") + F.col("_place")).drop("_part", "_start", "_place")
    )


def mix_order(seed: int, *key: str) -> Column:
    """A repeatable random order: the md5 of seed and row key, stable under repartitioning."""
    parts = [F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def flag_smallest(
    df: DataFrame, keys: list[str], order: str, quota: str, flag: str
) -> DataFrame:
    """Mark exactly the ``quota`` rows of each group with the smallest md5 text in ``order``.

    ``quota`` is a column that is constant within a group. See ``flag_by_threshold``.
    """
    df, keys = _keyed(df, keys)
    quotas = df.groupBy(*keys).agg(F.max(quota).alias("_wanted"))
    return flag_by_threshold(df, keys, order, quotas, flag).drop(_ALL)


def flag_by_threshold(df: DataFrame, keys: list[str], order: str, quotas: DataFrame, flag: str) -> DataFrame:
    """As ``flag_smallest``, with the quotas in a table (keys, ``_wanted``).

    The first four hex digits spread a group evenly over 65536 buckets; bucket totals say in which
    one the last wanted row lies, and only the texts of that bucket are sorted, to find the last
    wanted text. Then a row is marked by comparing its text with that of its group, so whole rows
    are not shuffled; only rows that share the last text while not all of them are wanted are
    numbered. The limits, one row per group, are sent to all tasks: pass few groups, such as the
    classes of a target.
    """
    slim = df.select(*keys, order, F.conv(F.substring(order, 1, 4), 16, 10).cast("long").alias("_bin"))
    totals = slim.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_one"))
    upto = F.sum("_one").over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
    cut = (
        totals.withColumn("_upto", upto).join(quotas, keys)
        .where((F.col("_wanted") <= F.col("_upto")) & (F.col("_wanted") > F.col("_upto") - F.col("_one")))
        .select(*keys, "_bin", (F.col("_wanted") - F.col("_upto") + F.col("_one")).alias("_inside"))
    )
    texts = slim.join(F.broadcast(cut), [*keys, "_bin"]).groupBy(*keys, order, "_inside").agg(F.count(F.lit(1)).alias("_ties"))
    before = F.coalesce(F.sum("_ties").over(W.partitionBy(*keys).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    last = (
        texts.withColumn("_take", F.col("_inside") - before)
        .where((F.col("_take") > 0) & (F.col("_take") <= F.col("_ties")))
        .select(*keys, F.col(order).alias("_last"), "_take", "_ties")
    )
    limits = quotas.join(last, keys, "left")  # no last text: none or all rows of the group are wanted
    told = df.join(F.broadcast(limits), keys)
    shared = F.coalesce((F.col(order) == F.col("_last")) & (F.col("_take") < F.col("_ties")), F.lit(False))
    wanted = F.when(F.col("_last").isNull(), F.col("_wanted") > 0).otherwise(F.col(order) <= F.col("_last"))
    place = F.row_number().over(W.partitionBy(*keys).orderBy(order))
    marked = told.where(~shared).withColumn(flag, wanted).unionByName(told.where(shared).withColumn(flag, place <= F.col("_take")))
    return marked.drop("_wanted", "_last", "_take", "_ties")
