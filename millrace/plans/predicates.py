"""Filters of a table query: a list of {field, operator, value}, joined by AND.

A field that the table lacks or an operator that doesn't exist is ignored.  Null never matches.
Typed columns keep their type in the predicate, so that it reaches the scan.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DataType, DateType, NumericType, TimestampNTZType, TimestampType

from millrace.functions.scalars import NUMBER, number, truth

ORDERINGS = {"gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def _is_number(value: Any) -> bool:
    import re

    return not isinstance(value, bool) and bool(re.match(NUMBER.replace("(?i:", "(?:(?i:").replace("nan)", "nan))"), str(value)))


def equals(column: Column, kind: DataType, value: Any) -> Column:
    """Numeric equality if both sides are numbers, otherwise equality as text."""
    if isinstance(kind, NumericType):
        return column == float(value) if _is_number(value) else F.lit(False)
    if isinstance(kind, BooleanType):
        return column == truth(F.lit(str(value)))
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return column == F.lit(str(value)).try_cast(kind.simpleString())
    if _is_number(value):
        parsed = number(column)
        return F.when(parsed.isNotNull(), parsed == float(value)).otherwise(column.cast("string") == str(value))
    return column.cast("string") == str(value)


def compares(column: Column, kind: DataType, operator: str, value: Any) -> Column:
    """Ordering against a number, or against a time for time columns; an unusable value is an error."""
    if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
        return getattr(column, ORDERINGS[operator])(F.lit(str(value)).cast(kind.simpleString()))
    return getattr(number(column, isinstance(kind, NumericType)), ORDERINGS[operator])(float(value))


def contains(column: Column, value: Any, literal: bool = False) -> Column:
    """Case-insensitive search for a pattern, or for the text itself."""
    text = column.cast("string")
    return F.lower(text).contains(str(value).lower()) if literal else text.rlike(f"(?i){value}")


def filtered(frame: DataFrame, filters: Sequence[dict[str, Any]]) -> DataFrame:
    """Rows that pass all filters."""
    for one in filters:
        field, operator, value = one.get("field"), one.get("operator", "eq"), one.get("value")
        if field not in frame.columns:
            continue
        column, kind = frame[field], frame.schema[field].dataType
        if operator == "eq":
            frame = frame.where(equals(column, kind, value))
        elif operator in ORDERINGS:
            frame = frame.where(compares(column, kind, operator, value))
        elif operator == "contains":
            frame = frame.where(contains(column, value))
        elif operator == "contains_text":
            frame = frame.where(contains(column, value, literal=True))
    return frame


def selected(frame: DataFrame, columns: Sequence[str] | None = None, most: int | None = 500, order: Sequence[str] = ()) -> DataFrame:
    """Requested columns that exist, in the order asked for, or all; the first ``most`` rows by ``order``."""
    picked = [c for c in columns or [] if c in frame.columns] or frame.columns
    if most is None:
        return frame.select(*picked)
    keys = [c for c in (order or picked) if c in frame.columns]
    return frame.orderBy(*[F.col(k).asc_nulls_last() for k in keys]).select(*picked).limit(most)


def resolve(frame: DataFrame, needle: str, key: str, title: str, most: int = 10) -> DataFrame:
    """Rows whose title holds ``needle``, with ``outcome`` found, ambiguous or not_found.

    A single match gives its key; several give up to ``most`` candidates; none gives one row of nulls.
    """
    hits = frame.where(F.lower(F.col(title)).contains(needle.lower())).select(F.col(key).cast("string").alias("key"), F.col(title).alias("title"))
    top = hits.orderBy("title", "key").limit(most)
    counted = hits.agg(F.count(F.lit(1)).alias("matches"))
    outcome = F.when(F.col("matches") == 0, "not_found").when(F.col("matches") == 1, "found").otherwise("ambiguous")
    return counted.join(top, F.lit(True), "left").select("key", "title", outcome.alias("outcome"))


def contained(candidates: DataFrame, haystack: str | Column, text: str) -> DataFrame:
    """Candidates with at least two characters, flagged if the text holds them in any case."""
    hay = F.lower(F.col(haystack) if isinstance(haystack, str) else haystack)
    return candidates.withColumn("present", (F.length(F.trim(F.col(text))) >= 2) & (F.instr(hay, F.lower(F.col(text))) > 0))
