"""Quantiles of large groups by counting against the built-in percentile and against sorted values."""

import math
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import quantiles as Q
from millrace.operators import tabular

AT = [0.0, 0.25, 0.5, 0.9, 1.0]


def plain(values, share):
    values = sorted(math.inf if math.isnan(v) else v for v in values)
    place = (len(values) - 1) * share
    low = math.floor(place)
    return values[low] if place == low else (low + 1 - place) * values[low] + (place - low) * values[low + 1]


def groups_of(seed):
    rng = random.Random(seed)
    return {
        "hot": [rng.lognormvariate(0, 4) for _ in range(700)],
        "ties": [float(rng.randrange(3)) for _ in range(300)],
        "one": [5.5] * 200,
        "tiny": [1.0, 2.0],
        "wide": [rng.choice([-1.7e308, 1.7e308, 5e-324, -5e-324, 0.0, 1.0]) for _ in range(101)],
        "odd": [math.inf, -math.inf, math.nan, 3.0, 4.0] * 21,
        None: [rng.random() for _ in range(60)],
    }


@pytest.mark.parametrize("most", [10, 100, 10_000])
def test_groups_of_any_size(spark, most):
    groups = groups_of(most)
    rows = [(g, v, "x") for g, values in groups.items() for v in values] + [("hot", None, "x"), ("empty", None, "x")]
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame(rows, "g string, value double, low string")
    found = {r.g: list(r.q) for r in Q.exact_quantiles(frame, AT, ["g"], most=most).collect()}
    assert found.keys() == groups.keys()
    for group, values in groups.items():
        for share, got in zip(AT, found[group], strict=True):
            expected = plain(values, share)
            assert got == expected or math.isclose(got, expected, rel_tol=1e-12) or (math.isnan(got) and group == "odd"), (group, share, got, expected)


def test_whole_table_and_empty(spark):
    frame = spark.range(1000).select((F.col("id") * 37 % 1000).cast("double").alias("value"))
    assert [tuple(r.q) for r in Q.exact_quantiles(frame, [0.5, 0.25], most=50).collect()] == [(499.5, 249.75)]
    assert Q.exact_quantiles(frame.limit(0), [0.5], most=50).collect() == []


def test_tables_above_the_bound_give_the_same(spark, monkeypatch):
    rng = random.Random(3)
    rows = [("a" if rng.random() < 0.7 else f"b{rng.randrange(4)}", rng.choice("xy"), rng.gauss(0, 9) if rng.random() < 0.9 else None, k) for k in range(400)]
    frame = spark.createDataFrame(rows, "g string, c string, v double, k long")

    def every():
        return [
            sorted(map(str, made.collect()))
            for made in (
                tabular.group_values(frame, "g", "v", "median"), tabular.group_query(frame, "g", "v", "median"), tabular.chart_values(frame, "g", "v", "median"), tabular.pivot_cells(frame, "g", "c", "v", "median"),
                tabular.pivot_wide(frame, "g", "c", ["x", "y"], "v", "median"), tabular.summary(frame, ["g", "v", "k"]), tabular.distribution_stats(frame, "v"), tabular.histogram(frame, "v"), tabular.outliers(frame, "v", "k"), tabular.outlier_stats(frame, "v", "k"),
            )
        ]

    whole = every()
    monkeypatch.setattr(Q, "MOST_IN_ONE", 20)
    assert every() == whole
