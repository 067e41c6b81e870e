"""Analyses of one table: grouped and pivoted values, series, summaries, distributions, relations.

Every result is a long-form DataFrame.  Aggregates are built-in and partial before the shuffle; a
second pass over the data happens only where a bound of the first is needed (histograms, outliers),
and the first pass's single row is broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DateType, NumericType, StringType, TimestampNTZType, TimestampType

from millrace.functions.scalars import finite, key_text, moment, number
from millrace.operators.quantiles import exact_quantiles, is_large
from millrace.plans.predicates import filtered

TIMES = (DateType, TimestampType, TimestampNTZType)


def aggregate(name: str, value: Column, of_nothing: bool = True) -> Column:
    """mean, sum, count, min, max or median; an unknown name is mean.  The sum of nulls alone is 0."""
    if name == "sum":
        return F.coalesce(F.sum(value), F.lit(0.0)) if of_nothing else F.sum(value)
    if name == "count":
        return F.count(value)
    if name in ("min", "max"):
        return getattr(F, name)(value)
    return F.percentile(value, 0.5) if name == "median" else F.avg(value)


def aggregated(rows: DataFrame, keys: Sequence[str], fn: str, value: str) -> DataFrame:
    """keys, value: one aggregate of a numeric column per group; a median of large tables is searched by counting."""
    if fn != "median" or not is_large(rows):
        return rows.groupBy(*keys).agg(finite(aggregate(fn, F.col(value))).alias("value"))
    medians = exact_quantiles(rows, [0.5], keys, value)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    return groups.join(medians, list(keys), "left").select(*keys, finite(F.element_at("q", 1)).alias("value"))


def with_quantiles(rows: DataFrame, moments: Sequence[Column], value: str, **at: float) -> DataFrame:
    """One row: aggregates of all rows, and exact quantiles of a column by name; those of a large table are searched by counting."""
    if not is_large(rows):
        whole = rows.agg(*moments, F.percentile(value, F.array(*map(F.lit, at.values()))).alias("__q"))
        return whole.withColumns({name: F.get("__q", F.lit(k)) for k, name in enumerate(at)}).drop("__q")
    stats = rows.agg(*moments)
    found = exact_quantiles(rows, list(at.values()), value=value)
    one = found.select(*(F.element_at("q", k + 1).alias(name) for k, name in enumerate(at)))
    # Both are one row; without values there are no quantiles, and a row of nulls stands for them.
    one = one.agg(*(F.max(name).alias(name) for name in at))
    return stats.withColumn("__one", F.lit(1)).join(F.broadcast(one.withColumn("__one", F.lit(1))), "__one").drop("__one")


def numeric(frame: DataFrame, field: str) -> Column:
    return number(F.col(field), isinstance(frame.schema[field].dataType, NumericType))


def need(frame: DataFrame, *fields: str) -> None:
    missing = [f for f in fields if f not in frame.columns]
    if missing:
        raise ValueError(f"no such field: {', '.join(missing)}")


# --- groups


def group_values(frame: DataFrame, group: str, value: str, fn: str = "mean") -> DataFrame:
    """label, value: one aggregate per group, highest first.  Rows with null group or value are dropped."""
    need(frame, group, value)
    rows = frame.select(F.col(group).alias("label"), numeric(frame, value).alias("value")).na.drop()
    grouped = aggregated(rows, ["label"], fn, "value")
    return grouped.orderBy(F.desc_nulls_last("value"), "label")


def group_query(frame: DataFrame, group: str, value: str | None = None, fn: str = "count") -> DataFrame:
    """label, value: as ``group_values``, but nulls of the value stay until the aggregate.

    Without a value field it counts rows, whatever ``fn`` says.  Null groups are dropped.
    """
    need(frame, group)
    rows = frame.where(F.col(group).isNotNull())
    if value in frame.columns:
        grouped = aggregated(rows.select(F.col(group).alias("label"), numeric(frame, value).alias("v")), ["label"], fn, "v")
    else:
        grouped = rows.groupBy(F.col(group).alias("label")).agg(finite(F.count(F.lit(1))).alias("value"))
    return grouped.orderBy(F.desc_nulls_last("value"), "label")


def group_stats(frame: DataFrame, group: str, value: str) -> DataFrame:
    """groups, records: distinct groups and rows with neither null."""
    rows = frame.select(F.col(group).alias("g"), numeric(frame, value).alias("v")).na.drop()
    return rows.agg(F.count_distinct("g").alias("groups"), F.count(F.lit(1)).alias("records"))


def join_tables(first: DataFrame, *others: DataFrame, on: str) -> DataFrame:
    """Inner joins on one field that all have; null keys meet null keys, as equal values do.

    A table without the field is skipped.  Clashing names of later tables get ``_r``, ``_r2`` and so on.
    """
    result = first
    for other in others:
        if on not in result.columns or on not in other.columns:
            continue
        taken, names = set(result.columns), {}
        for column in other.columns:
            if column == on:
                names[column] = "__key"
                continue
            name, turn = column, 1
            while name in taken:
                name = f"{column}_r" if turn == 1 else f"{column}_r{turn}"
                turn += 1
            names[column] = name
            taken.add(name)
        renamed = other.select(*(F.col(f"`{c}`").alias(names[c]) for c in other.columns))
        result = result.join(renamed, result[on].eqNullSafe(renamed["__key"]), "inner").drop("__key")
    return result


def resolve_labels(grouped: DataFrame, lookup: DataFrame, key: str, display: str, label: str = "label") -> DataFrame:
    """Replace a group's key by the display text of the looked-up row; a key that isn't found stays as text.

    Labels are looked up after the aggregation, when few are left; of several rows of a key the least
    display text is taken.  Keys are compared as text, so 5.0 finds 5.
    """
    numeric_key = isinstance(lookup.schema[key].dataType, NumericType)
    names = lookup.groupBy(key_text(F.col(key), numeric_key).alias("__k")).agg(F.min(F.col(display).cast("string")).alias("__d"))
    own = key_text(F.col(label), isinstance(grouped.schema[label].dataType, NumericType))
    joined = grouped.join(names, own == F.col("__k"), "left")
    return joined.withColumn(label, F.coalesce("__d", own)).drop("__k", "__d")


# --- charts


def chart_values(
    frame: DataFrame,
    x: str,
    y: str | None = None,
    fn: str = "count",
    sort: str = "value",
    descending: bool = True,
    limit: int | None = 20,
    filters: Sequence[dict] = (),
) -> DataFrame:
    """label, value: an aggregate of y, or a count, for each x, sorted and cut to ``limit`` (none if not positive).

    Null x is a group of its own only with y; rows with null y are dropped.
    """
    frame = filtered(frame, filters)
    need(frame, x)
    if y in frame.columns:
        rows = frame.select(F.col(x).alias("label"), numeric(frame, y).alias("v")).where("v is not null and label is not null")
        result = aggregated(rows, ["label"], fn, "v")
    else:
        result = frame.where(F.col(x).isNotNull()).groupBy(F.col(x).alias("label")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    by = "label" if sort == "label" else "value"
    result = result.orderBy(F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last(), "label")
    return result.limit(limit) if limit and limit > 0 else result


def chart_stats(values: DataFrame) -> DataFrame:
    """categories, least, most, total of a chart's rows, after its limit."""
    return values.agg(F.count(F.lit(1)).alias("categories"), finite(F.min("value")).alias("least"), finite(F.max("value")).alias("most"), finite(F.sum("value")).alias("total"))


def scatter(frame: DataFrame, x: str, y: str, limit: int | None = None) -> DataFrame:
    """x, y of rows where both are numbers; the first ``limit`` by x and y if given."""
    need(frame, x, y)
    rows = frame.select(finite(numeric(frame, x)).alias("x"), finite(numeric(frame, y)).alias("y")).na.drop()
    return rows.orderBy("x", "y").limit(limit) if limit else rows


# --- pivots


#: Cells up to which a pivot's grid is filled with zeros.
MAX_GRID = 100_000_000


def pivot_filled(frame: DataFrame, row: str, column: str, value: str | None = None, fn: str = "count") -> DataFrame:
    """row, col, value: the cells that rows fall into, of any number of labels.

    Cells that are null, which mean, min, max and median may give, are left out; sum and count give 0 and keep them.
    """
    need(frame, row, column)
    rows = frame.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    if value in frame.columns:
        cells = aggregated(rows.select(F.col(row).alias("row"), F.col(column).alias("col"), numeric(frame, value).alias("v")), ["row", "col"], fn, "v")
    else:
        cells = rows.groupBy(F.col(row).alias("row"), F.col(column).alias("col")).agg(finite(F.count(F.lit(1))).alias("value"))
    return cells.where("value is not null")


def pivot_cells(frame: DataFrame, row: str, column: str, value: str | None = None, fn: str = "count") -> DataFrame:
    """row, col, value: every cell of the grid, 0 where there is none.

    Rows and columns whose cells are all null are left out.  The grid is the cross of the labels of ``pivot_filled``; they
    are counted first, and a grid above ``MAX_GRID`` cells is an error, never a part of it.
    """
    kept = pivot_filled(frame, row, column, value, fn)
    rows, columns = kept.agg(F.count_distinct("row"), F.count_distinct("col")).first()
    if rows * columns > MAX_GRID:
        raise ValueError(f"a grid of {rows} rows and {columns} columns is above {MAX_GRID} cells: use pivot_filled, which leaves zeros out")
    many, few = (kept.select(name).distinct() for name in (("row", "col") if rows > columns else ("col", "row")))
    grid = many.join(F.broadcast(few), how="cross")
    return grid.join(kept, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0.0)).alias("value"))


def pivot_wide(frame: DataFrame, row: str, column: str, columns: Sequence[str], value: str | None = None, fn: str = "count") -> DataFrame:
    """One column per given label; the labels are given, so that no extra pass looks for them."""
    rows = frame.where(F.col(row).isNotNull())
    if value in frame.columns and fn == "median" and is_large(rows):
        cells = aggregated(rows.select(F.col(row).alias("row"), F.col(column).alias("col"), numeric(frame, value).alias("v")), ["row", "col"], fn, "v")
        return cells.groupBy("row").pivot("col", list(columns)).agg(F.max("value")).na.fill(0.0)
    measure = F.count(F.lit(1)) if value not in frame.columns else aggregate(fn, numeric(frame, value))
    return rows.groupBy(F.col(row).alias("row")).pivot(column, list(columns)).agg(finite(measure)).na.fill(0.0)


def pivot_totals(cells: DataFrame) -> DataFrame:
    """axis, label, total: sums of the cells by row, by column and in all; zeros make no difference."""
    sums = cells.groupingSets([["row"], ["col"], []], "row", "col").agg(F.sum("value").alias("total"), F.grouping("row").alias("gr"), F.grouping("col").alias("gc"))
    axis = F.when((F.col("gr") == 0), "row").when(F.col("gc") == 0, "col").otherwise("all")
    return sums.select(axis.alias("axis"), F.coalesce(F.col("row").cast("string"), F.col("col").cast("string")).alias("label"), finite("total").alias("total"))


# --- series


def period_end(column: Column, period: str) -> Column:
    """Last day of the month, quarter, year or week (Sunday), or the day or hour itself."""
    day = column.cast("date")
    kind = period.upper()
    if kind in ("M", "ME"):
        return F.last_day(day)
    if kind in ("Q", "QE"):
        return F.last_day(F.add_months(F.date_trunc("quarter", day).cast("date"), 2))
    if kind in ("Y", "YE", "A"):
        return F.make_date(F.year(day), F.lit(12), F.lit(31))
    if kind == "W":
        return F.next_day(F.date_sub(day, 1), "SUN")
    if kind == "D":
        return day
    if kind == "H":
        return F.date_trunc("hour", column).cast("timestamp_ntz")
    raise ValueError(f"unknown period: {period}")


def time_series(frame: DataFrame, date: str, value: str, period: str = "ME") -> DataFrame:
    """period_end, value: mean per period; periods without values are left out."""
    need(frame, date, value)
    when = F.col(date) if isinstance(frame.schema[date].dataType, TIMES) else moment(date)
    rows = frame.select(period_end(when, period).alias("period_end"), numeric(frame, value).alias("v")).na.drop()
    return rows.groupBy("period_end").agg(finite(F.avg("v")).alias("value")).orderBy("period_end")


def trend(series: DataFrame) -> DataFrame:
    """periods, slope: least squares over the period's number; null for fewer than two.

    The series has one row per period, so numbering it in one task is bounded by the calendar.
    """
    numbered = series.withColumn("n", F.row_number().over(Window.orderBy("period_end")) - 1)
    return numbered.agg(F.count(F.lit(1)).alias("periods"), finite(slope(F.col("n"), F.col("value"))).alias("slope"))


# --- summaries

SUMMARY = "field string, type string, total_count long, non_null_count long, null_count long, null_percent double, mean double, median double, std double, min double, max double, unique_count long, top_value string, min_date string, max_date string"


def kind_of(frame: DataFrame, field: str) -> str:
    kind = frame.schema[field].dataType
    if isinstance(kind, NumericType):
        return "number"
    return "date" if isinstance(kind, TIMES) else "boolean" if isinstance(kind, BooleanType) else "text" if isinstance(kind, StringType) else "other"


def most_frequent(frame: DataFrame, field: str) -> DataFrame:
    """value, n: the most frequent value, of equal ones the least; no row if all are null."""
    return frame.where(F.col(field).isNotNull()).groupBy(F.col(field).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(1)


def summary(frame: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per field: counts for all, moments of numbers, distinct and top value of texts, range of dates.

    Numbers, counts and ranges of all fields are one pass; each text field adds a grouped count.
    """
    fields = [f for f in fields or frame.columns if f in frame.columns]
    large = any(kind_of(frame, f) == "number" for f in fields) and is_large(frame)
    parts: list[Column] = []
    for at, field in enumerate(fields):
        x, kind = F.col(field), kind_of(frame, field)
        value = x.cast("double")
        nothing, none = F.lit(None).cast("double"), F.lit(None).cast("string")
        is_number, is_date = kind == "number", kind == "date"
        text = lambda c: F.date_format(c, "yyyy-MM-dd")
        parts.append(
            F.struct(
                F.lit(field).alias("field"),
                F.lit(kind).alias("type"),
                F.count(F.lit(1)).alias("total_count"),
                F.count(x).alias("non_null_count"),
                (F.count(F.lit(1)) - F.count(x)).alias("null_count"),
                F.round((F.count(F.lit(1)) - F.count(x)) * 100.0 / F.greatest(F.count(F.lit(1)), F.lit(1)), 2).alias("null_percent"),
                (finite(F.avg(value)) if is_number else nothing).alias("mean"),
                (finite(F.percentile(value, 0.5)) if is_number and not large else nothing).alias("median"),
                (finite(F.stddev_samp(value)) if is_number else nothing).alias("std"),
                (finite(F.min(value)) if is_number else nothing).alias("min"),
                (finite(F.max(value)) if is_number else nothing).alias("max"),
                (text(F.min(x)) if is_date else none).alias("min_date"),
                (text(F.max(x)) if is_date else none).alias("max_date"),
            ).alias(f"f{at}")
        )
    wide = frame.agg(*parts).select(F.explode(F.array(*(F.col(f"f{at}") for at in range(len(fields))))).alias("s")).select("s.*")
    if large:
        numbers = [f for f in fields if kind_of(frame, f) == "number"]
        medians = [exact_quantiles(frame, [0.5], value=f).select(F.lit(f).alias("field"), finite(F.element_at("q", 1)).alias("__median")) for f in numbers]
        wide = wide.join(F.broadcast(reduce(DataFrame.unionByName, medians)), "field", "left").withColumn("median", F.col("__median")).drop("__median")
    texts = [f for f in fields if kind_of(frame, f) == "text"]
    if texts:
        counted = []
        for field in texts:
            groups = frame.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("v")).agg(F.count(F.lit(1)).alias("n"))
            counted.append(groups.agg(F.lit(field).alias("field"), F.count(F.lit(1)).alias("unique_count"), F.min(F.struct(-F.col("n"), "v"))["v"].alias("top_value")))
        tops = reduce(DataFrame.unionByName, counted)
    else:
        tops = frame.sparkSession.createDataFrame([], "field string, unique_count long, top_value string")
    order = [c.split()[0] for c in SUMMARY.split(", ")]
    return wide.join(F.broadcast(tops), "field", "left").select(*order)


# --- distributions


def skew_kurtosis(value: Column) -> tuple[Column, Column]:
    """Bias-corrected skewness and excess kurtosis, as sample statistics; null where too few values."""
    n = F.count(value).cast("double")
    skew = F.when(n > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))
    kurtosis = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))
    return skew, kurtosis


def distribution_stats(frame: DataFrame, field: str) -> DataFrame:
    """n, mean, median, std, min, max, q25, q75, skew, kurtosis of a numeric field, in one pass unless the table is large."""
    need(frame, field)
    v = F.col("v")
    skew, kurtosis = skew_kurtosis(v)
    rows = frame.select(numeric(frame, field).alias("v")).where("v is not null")
    moments = {"n": F.count("v"), "mean": finite(F.avg("v")), "std": finite(F.stddev_samp("v")), "min": finite(F.min("v")), "max": finite(F.max("v")), "skew": finite(skew), "kurtosis": finite(kurtosis)}
    at = {"median": 0.5, "q25": 0.25, "q75": 0.75}
    stats = with_quantiles(rows, [c.alias(name) for name, c in moments.items()], "v", **at).withColumns({name: finite(name) for name in at})
    return stats.select("n", "mean", "median", "std", "min", "max", "q25", "q75", "skew", "kurtosis")


def bin_count(bounds: Column, bins: int | str) -> Column:
    """Number of equal bins: as given, or chosen from the spread for ``auto``."""
    if not isinstance(bins, str) or bins.strip().isdigit():
        return F.lit(max(1, int(bins)))
    n, width = bounds["n"].cast("double"), bounds["hi"] - bounds["lo"]
    sturges = width / (F.log2(n) + 1)
    freedman = 2 * (bounds["q75"] - bounds["q25"]) / F.pow(n, F.lit(1 / 3))
    # The narrower of both rules, but no narrower than half of what the square root rule gives.
    bandwidth = F.least(F.greatest(freedman, width / F.sqrt(n) / 2), sturges)
    chosen = F.when(freedman > 0, bandwidth).otherwise(sturges)
    return F.when(width > 0, F.greatest(F.ceil(width / chosen), F.lit(1))).otherwise(1).cast("int")


def histogram(frame: DataFrame, field: str, bins: int | str = "auto") -> DataFrame:
    """bin, bin_lo, bin_hi, n: equal bins from least to greatest value, the last one closed.

    Empty bins have n = 0; a constant field has one bin around it.  Two passes; the bounds are one row.
    """
    need(frame, field)
    rows = frame.select(numeric(frame, field).alias("v")).where("v is not null and not isnan(v)")
    ends = (F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    fixed = isinstance(bins, int) or bins.strip().isdigit()
    bounds = (rows.agg(*ends) if fixed else with_quantiles(rows, ends, "v", q25=0.25, q75=0.75)).where("n > 0")
    flat = F.col("hi") == F.col("lo")
    edges = bounds.select(F.struct("*").alias("b")).select(bin_count(F.col("b"), bins).alias("k"), F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"))
    edges = edges.select("k", F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"), F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"))
    edges = edges.withColumn("w", (F.col("hi") - F.col("lo")) / F.col("k"))
    placed = rows.join(F.broadcast(edges), how="cross").select(F.least(F.floor((F.col("v") - F.col("lo")) / F.col("w")), F.col("k") - 1).cast("int").alias("bin"))
    counts = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = edges.select("lo", "w", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    return every.join(counts, "bin", "left").select(
        "bin", finite(F.col("lo") + F.col("bin") * F.col("w")).alias("bin_lo"), finite(F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("bin_hi"), F.coalesce("n", F.lit(0)).alias("n")
    )


def value_counts(frame: DataFrame, field: str, limit: int = 30) -> DataFrame:
    """label, n: the most frequent values, of equal ones the least label first."""
    need(frame, field)
    counted = frame.where(F.col(field).isNotNull()).groupBy(F.col(field).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "label").limit(limit)


# --- outliers


def _fences(rows: DataFrame) -> DataFrame:
    moments = (F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    stats = with_quantiles(rows, moments, "value", q1=0.25, q3=0.75)
    spread = F.col("q3") - F.col("q1")
    return stats.withColumns({"low": F.col("q1") - 1.5 * spread, "high": F.col("q3") + 1.5 * spread})


def outliers(frame: DataFrame, field: str, key: str) -> DataFrame:
    """record_id, value, z, is_outlier: every value beyond one and a half quartile distances; none below four values."""
    need(frame, field, key)
    rows = frame.select(F.col(key).alias("record_id"), numeric(frame, field).alias("value")).where("value is not null")
    bounds = _fences(rows).where("n >= 4").select("low", "high", "mean", "std")
    z = F.when(F.col("std") > 0, F.abs(F.col("value") - F.col("mean")) / F.col("std")).otherwise(0.0)
    flagged = rows.join(F.broadcast(bounds), how="cross").withColumns({"z": z, "is_outlier": (F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))})
    return flagged.where("is_outlier").select("record_id", finite("value").alias("value"), finite("z").alias("z"), "is_outlier")


def outlier_stats(frame: DataFrame, field: str, key: str) -> DataFrame:
    """n, q1, q3, low, high, iqr_outliers, z_outliers of a field."""
    rows = frame.select(F.col(key).alias("record_id"), numeric(frame, field).alias("value")).where("value is not null")
    bounds = _fences(rows).where("n >= 4")
    z = F.when(F.col("std") > 0, F.abs(F.col("value") - F.col("mean")) / F.col("std")).otherwise(0.0)
    every = rows.select("value").join(F.broadcast(bounds), how="cross")
    counted = every.groupBy("n", "q1", "q3", "low", "high").agg(
        F.count_if((F.col("value") < F.col("low")) | (F.col("value") > F.col("high"))).alias("iqr_outliers"), F.count_if(z > 3).alias("z_outliers")
    )
    return counted.select("n", *(finite(c).alias(c) for c in ("q1", "q3", "low", "high")), "iqr_outliers", "z_outliers")


# --- relations


def beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_fraction(b, a, 1 - x)
    scale = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 / max(1 - (a + b) * x / (a + 1), 1e-300)
    result = d
    for m in range(1, 400):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or tiny)
            c = 1 + step / c or tiny
            result *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return scale * result


def correlation_p(r: float, n: int) -> float | None:
    """Two-sided p-value of a correlation of ``n`` pairs; null below three."""
    if r is None or n is None or n < 3 or r != r:
        return None
    if n == 2 or abs(r) >= 1:
        return 0.0
    df = n - 2
    t2 = r * r * df / (1 - r * r)
    return beta_fraction(df / 2, 0.5, df / (df + t2))


def with_p_value(frame: DataFrame, r: str = "r", n: str = "n") -> DataFrame:
    """Add ``p_value``; runs on aggregated rows only."""

    @F.pandas_udf("double")
    def p(rs: pd.Series, ns: pd.Series) -> pd.Series:
        return pd.Series([correlation_p(a, int(b)) if a == a and a is not None else None for a, b in zip(rs, ns, strict=True)], dtype="float64")

    return frame.withColumn("p_value", p(F.col(r), F.col(n)))


def pearson(x: Column, y: Column) -> Column:
    """Correlation of pairs with both; null if one side is constant."""
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.sqrt(F.var_pop(a)) * F.sqrt(F.var_pop(b))
    return F.when(spread > 0, F.covar_pop(x, y) / spread)


def slope(x: Column, y: Column) -> Column:
    """Least squares slope of y over x; null if x is constant."""
    width = F.var_pop(F.when(y.isNotNull(), x))
    return F.when(width > 0, F.covar_pop(x, y) / width)


def correlation(frame: DataFrame, first: str, second: str, least: int = 3) -> DataFrame:
    """n, r, r_squared, slope, intercept, x_min, x_max over rows with both; no row below ``least`` pairs."""
    need(frame, first, second)
    rows = frame.select(numeric(frame, first).alias("x"), numeric(frame, second).alias("y")).na.drop()
    stats = rows.agg(
        F.count(F.lit(1)).alias("n"),
        pearson(F.col("x"), F.col("y")).alias("r"),
        slope(F.col("x"), F.col("y")).alias("slope"),
        (F.avg("y") - slope(F.col("x"), F.col("y")) * F.avg("x")).alias("intercept"),
        F.min("x").alias("x_min"),
        F.max("x").alias("x_max"),
    ).where(F.col("n") >= least)
    rounded = [finite(c).alias(c) for c in ("slope", "intercept", "x_min", "x_max")]
    return stats.select("n", finite("r").alias("r"), finite(F.col("r") * F.col("r")).alias("r_squared"), *rounded)


def correlation_matrix(frame: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """field1, field2, r, n for every pair of numeric fields and each with itself, pairwise complete, in one pass.

    r is null below three pairs and 1 for a field with itself.
    """
    names = [f for f in (fields or frame.columns) if f in frame.columns and isinstance(frame.schema[f].dataType, NumericType)]
    if len(names) < 2:
        raise ValueError("a correlation matrix needs two numeric fields")
    cells = []
    for i, a in enumerate(names):
        for b in names[i:]:
            x, y = F.col(a).cast("double"), F.col(b).cast("double")
            n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
            r = F.lit(1.0) if a == b else F.when(n >= 3, finite(pearson(x, y)))
            cells.append(F.struct(F.lit(a).alias("field1"), F.lit(b).alias("field2"), r.alias("r"), n.alias("n")).alias(f"c{len(cells)}"))
    wide = frame.agg(*cells)
    return wide.select(F.explode(F.array(*(F.col(f"c{k}") for k in range(len(cells))))).alias("c")).select("c.*")


def strong_correlations(matrix: DataFrame, least: float = 0.5, limit: int = 10) -> DataFrame:
    """The strongest pairs of different fields with absolute correlation at least ``least``."""
    pairs = matrix.where((F.col("field1") != F.col("field2")) & (F.abs("r") >= least))
    return pairs.orderBy(F.desc(F.abs("r")), "field1", "field2").limit(limit)
