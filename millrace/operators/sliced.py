"""Positions and predecessors in the order of a group of any size.

A window over a group that holds a third of all rows is one task.  Here the order is cut into slices:
a window runs inside each (group, slice), and what it needs of the slices before, a count or a last
row, comes from a much smaller window over one row per group and slice.  The caller's slice must
grow with the order and be fine enough that one slice fits a task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the carry of their group and slice; null groups are groups."""
    renamed = carry.select(*(F.col(k).alias(f"__{k}") for k in keys), F.col("__slice").alias("__of"), "__carry")
    same = reduce(Column.__and__, (rows[k].eqNullSafe(renamed[f"__{k}"]) for k in keys)) & rows["__slice"].eqNullSafe(renamed["__of"])
    return rows.join(renamed, same, "left").drop("__of", *(f"__{k}" for k in keys))


def with_position(rows: DataFrame, keys: Sequence[str], slice_of: Column, order: Sequence[Column], name: str) -> DataFrame:
    """Add ``name``: the place of each row, from 1, in its group by slice and then by ``order``, which must leave no ties that matter."""
    cut = rows.withColumn("__slice", slice_of)
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("n"))
    carry = counts.withColumn("__carry", F.coalesce(F.sum("n").over(before), F.lit(0)))
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order)
    return _joined(cut, carry, keys).withColumn(name, (F.row_number().over(inside) + F.col("__carry")).cast("long")).drop("__slice", "__carry")


def with_previous(rows: DataFrame, keys: Sequence[str], slice_of: Column, order: Sequence[str], column: str, name: str) -> DataFrame:
    """Add ``name``: ``column`` of the row before in the group, by slice and then by the ``order`` columns, nulls first; null for the first row."""
    cut = rows.withColumn("__slice", slice_of)
    inside = Window.partitionBy(*keys, "__slice").orderBy(*order)
    # Structs compare with nulls first too.
    last = cut.groupBy(*keys, "__slice").agg(F.max(F.struct(*order, F.struct(F.col(column).alias("v")).alias("l")))["l"].alias("last"))
    carry = last.withColumn("__carry", F.lag("last").over(Window.partitionBy(*keys).orderBy("__slice")))
    joined = _joined(cut, carry, keys).withColumn("__first", F.row_number().over(inside) == 1)
    return joined.withColumn(name, F.when(F.col("__first"), F.col("__carry")["v"]).otherwise(F.lag(column).over(inside))).drop("__slice", "__carry", "__first")
