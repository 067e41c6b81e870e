"""Exact quantiles of groups of any size.

The built-in exact percentile keeps all distinct values of a group in one buffer, which a group with
a third of a large table doesn't fit.  Here such groups are searched by counting: a pass counts the
values of the range that holds a wanted rank in ``BINS`` equal bins, with partial sums before the
shuffle, and the bin that holds the rank, cut to the least and greatest value in it, is the range of
the next pass.  A range ends when it is one value.  What is kept between passes are a few numbers per
large group; no task ever holds a group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import SharedTables

#: Values up to which a group's distinct ones may be held in one buffer.
MOST_IN_ONE = 500_000
BINS = 4_096
#: Large groups whose keys and ranges are broadcast at most; more are joined as the planner sees fit.
MOST_BROADCAST = 100_000


def is_large(rows: DataFrame, most: int | None = None) -> bool:
    """Whether a table has more rows than one buffer may hold, so that a group of it could."""
    return rows.count() > (MOST_IN_ONE if most is None else most)


def _bin(x: Column, low: Column, high: Column) -> Column:
    """Bin of a value of a range, from 0 for its least to ``BINS`` - 1 for its greatest value."""
    # By halves, so that no width overflows; between infinite ends all other values share a bin.
    share = F.try_divide(x / 2 - low / 2, high / 2 - low / 2)
    inside = F.when(F.isnan(share) | share.isNull(), F.lit(BINS // 2)).otherwise(F.greatest(F.least(F.floor(share * BINS), F.lit(BINS - 2)), F.lit(1)))
    return F.when(x == low, 0).when(x == high, BINS - 1).otherwise(inside).cast("int")


def exact_quantiles(rows: DataFrame, at: Sequence[float], keys: Sequence[str] = (), value: str = "value", most: int | None = None) -> DataFrame:
    """keys, q: the quantiles ``at`` of each group's values, between neighbours by linear interpolation.

    Null values are left out, not-a-number counts as the greatest value (and infinite), and a group
    without values has no row.  Groups of more than ``most`` values are searched by counting, all
    others use one buffer each; both give the same.
    """
    most = MOST_IN_ONE if most is None else most
    names = list(keys) or ["__all"]
    x = F.col(value).cast("double")
    rows = rows.where(F.col(value).isNotNull()).select(*(keys or [F.lit(0).alias("__all")]), F.when(F.isnan(x), float("inf")).otherwise(x).alias("x"))
    store = SharedTables(rows.sparkSession)
    sizes = rows.groupBy(*names).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).where(F.col("n") > most)
    large = store.put("large", sizes)
    same = lambda other: reduce(Column.__and__, (rows[k].eqNullSafe(other[k]) for k in names))
    sent = F.broadcast if large.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST else lambda table: table
    few = sent(large.select(*names))
    small = rows.join(few, same(few), "left_anti").groupBy(*names).agg(F.percentile("x", F.array(*map(F.lit, at))).alias("q"))
    targets = store.put("targets-0", _targets(large, names, at))
    step = 0
    while not targets.where("low < high").isEmpty():
        step += 1
        targets = store.put(f"targets-{step}", _narrowed(rows, targets, names, sent))
    found = targets.groupBy(*names, "at").agg(F.sum(F.col("weight") * F.col("low")).alias("v"))
    hot = found.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("q")).withColumn("q", F.transform("q", lambda s: s["v"]))
    return small.unionByName(hot).select(*keys, "q")


def _targets(large: DataFrame, names: list[str], at: Sequence[float]) -> DataFrame:
    """Ranks that the quantiles lie at or between, with their weights and the range that holds them."""
    ranks = []
    for number, share in enumerate(at):
        place = (F.col("n") - 1) * F.lit(float(share))
        below = F.floor(place)
        ranks.append(F.struct(F.lit(number).alias("at"), below.cast("long").alias("rank"), (below + 1 - place).alias("weight")))
        ranks.append(F.struct(F.lit(number).alias("at"), (below + 1).cast("long").alias("rank"), (place - below).alias("weight")))
    each = large.select(*names, "low", "high", F.lit(0).cast("long").alias("below"), F.explode(F.array(*ranks)).alias("r"))
    return each.select(*names, "low", "high", "below", "r.*").where("weight > 0")


def _narrowed(rows: DataFrame, targets: DataFrame, names: list[str], sent: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The targets with the range of each cut to the bin that holds its rank."""
    ranges = sent(targets.where("low < high").select(*names, "low", "high").distinct())
    group = reduce(Column.__and__, (rows[k].eqNullSafe(ranges[k]) for k in names))
    held = rows.join(ranges, group & (F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high")))
    held = held.select(*(ranges[k] for k in names), "low", "high", "x")
    bins = held.groupBy(*names, "low", "high", _bin(F.col("x"), F.col("low"), F.col("high")).alias("bin")).agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))
    before = Window.partitionBy(*names, "low", "high").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select(*(F.col(k).alias(f"of_{k}") for k in names), F.col("low").alias("of_low"), F.col("high").alias("of_high"), "n", "least", "most", "before")
    mine = reduce(Column.__and__, (targets[k].eqNullSafe(bins[f"of_{k}"]) for k in names)) & (F.col("low") == F.col("of_low")) & (F.col("high") == F.col("of_high"))
    inside = (F.col("rank") >= F.col("below") + F.col("before")) & (F.col("rank") < F.col("below") + F.col("before") + F.col("n"))
    open_, done = targets.where("low < high"), targets.where("low >= high")
    moved = open_.join(bins, mine & inside).select(*names, F.col("least").alias("low"), F.col("most").alias("high"), (F.col("below") + F.col("before")).alias("below"), "at", "rank", "weight")
    return moved.unionByName(done)
