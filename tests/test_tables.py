"""Table operators on the small awkward cases: nulls, ties, constant and dirty columns, empty tables."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from millrace.functions import scalars
from millrace.operators import tabular as T
from millrace.plans import registry
from millrace.plans.predicates import filtered, resolve, selected
from millrace.sources.readers import DatasetSchema, Field, parse_file, typed_records


def test_guarded_numbers(spark):
    rows = [("5",), (" 5 ",), ("1e3",), ("5d",), ("0x1F",), ("1_000",), ("inf",), ("",), (None,), ("-.5",)]
    got = [r.n for r in spark.createDataFrame(rows, "t string").select(scalars.number("t").alias("n")).collect()]
    assert got == [5.0, 5.0, 1000.0, None, None, None, math.inf, None, None, -0.5]
    safe = [r.n for r in spark.createDataFrame(rows, "t string").select(scalars.finite(scalars.number("t")).alias("n")).collect()]
    assert safe[6] is None and safe[0] == 5.0


def test_booleans_keys_and_durations(spark):
    got = spark.createDataFrame([("true", "5.0", 3725.0), ("FALSE", "5", 65.9), ("", "x", 0.0), (None, None, None)], "b string, k string, d double")
    rows = got.select(scalars.truth("b").alias("b"), scalars.key_text("k").alias("k"), scalars.duration_text("d").alias("d")).collect()
    assert [tuple(r) for r in rows] == [(True, "5", "1:02:05"), (False, "5", "1:05"), (None, "x", "0:00"), (None, None, None)]


def test_typed_records_are_lenient(spark):
    records = spark.createDataFrame([(1, '{"n": "5d", "b": "false", "d": "2024-01-31", "more": "x"}'), (2, '{"n": 7}'), (3, "{bad"), (4, None)], "id long, data string")
    schema = DatasetSchema((Field("n", "number"), Field("b", "boolean"), Field("d", "date"), Field("gone")), ("more",))
    rows = {r._id: r for r in typed_records(records, schema).collect()}
    assert rows[1].n is None and rows[1].b is False and rows[1].d == datetime(2024, 1, 31) and rows[1].more == "x"
    assert rows[2].n == 7.0 and rows[2].b is None and rows[3].n is None and rows[4].gone is None


def test_filters(spark):
    frame = spark.createDataFrame([(1, "5", 2.0, "Ab"), (2, "5.0", None, "cab"), (3, None, 7.0, None)], "id long, t string, x double, s string")
    ids = lambda *f: sorted(r.id for r in filtered(frame, f).collect())
    assert ids({"field": "t", "value": 5}) == [1, 2] and ids({"field": "t", "value": "5"}) == [1, 2]
    assert ids({"field": "x", "operator": "gt", "value": "1"}) == [1, 3]
    assert ids({"field": "s", "operator": "contains", "value": "^a"}) == [1] and ids({"field": "s", "operator": "contains_text", "value": "B"}) == [1, 2]
    assert ids({"field": "none", "value": 1}, {"field": "x", "operator": "odd", "value": 1}) == [1, 2, 3]
    with pytest.raises(ValueError):
        ids({"field": "x", "operator": "gt", "value": "high"})
    assert [r.id for r in selected(frame, ["id", "nowhere"], 2).collect()] == [1, 2] and selected(frame, ["id"], 2).columns == ["id"]


def test_resolve(spark):
    frame = spark.createDataFrame([(1, "Blue note"), (2, "Blue list"), (3, "Red")], "id long, title string")
    assert [tuple(r) for r in resolve(frame, "red", "id", "title").collect()] == [("3", "Red", "found")]
    assert [r.outcome for r in resolve(frame, "BLUE", "id", "title").collect()] == ["ambiguous"] * 2
    assert [tuple(r) for r in resolve(frame, "x y", "id", "title").collect()] == [(None, None, "not_found")]


def test_groups_with_nulls_and_ties(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 1.0), ("c", None), (None, 9.0)], "g string, v double")
    assert [tuple(r) for r in T.group_values(frame, "g", "v", "sum").collect()] == [("a", 1.0), ("b", 1.0)]
    assert {tuple(r) for r in T.group_query(frame, "g", "v", "sum").collect()} == {("a", 1.0), ("b", 1.0), ("c", 0.0)}
    assert {tuple(r) for r in T.group_query(frame, "g", None, "sum").collect()} == {("a", 2.0), ("b", 1.0), ("c", 1.0)}
    assert {tuple(r) for r in T.group_query(frame, "g", "v", "nonsense").collect()} == {("a", 1.0), ("b", 1.0), ("c", None)}
    with pytest.raises(ValueError):
        T.group_values(frame, "g", "nowhere")
    assert T.group_values(frame.limit(0), "g", "v").count() == 0


def test_null_keys_meet_in_joins(spark):
    left = spark.createDataFrame([(1, "x"), (None, "y")], "k long, v string")
    right = spark.createDataFrame([(None, "p"), (2, "q")], "k long, v string")
    joined = T.join_tables(left, right, right, on="k")
    assert joined.columns == ["k", "v", "v_r", "v_r2"] and [tuple(r) for r in joined.collect()] == [(None, "y", "p", "p")]
    assert T.join_tables(left, right.withColumnRenamed("k", "z"), on="k").columns == ["k", "v"]


def test_labels_fall_back_to_keys(spark):
    grouped = spark.createDataFrame([(1.0, 5.0), (9.0, 4.0)], "label double, value double")
    lookup = spark.createDataFrame([(1, "one"), (1, "uno")], "id long, name string")
    assert {tuple(r) for r in T.resolve_labels(grouped, lookup, "id", "name").collect()} == {("one", 5.0), ("9", 4.0)}


def test_sparse_pivot(spark):
    frame = spark.createDataFrame([("r", "c", 1.0), ("r", "d", None), ("s", "c", 2.0), ("t", "e", None)], "r string, c string, v double")
    mean = {(r.row, r.col): r.value for r in T.pivot_cells(frame, "r", "c", "v", "mean").collect()}
    assert mean == {("r", "c"): 1.0, ("s", "c"): 2.0}
    count = {(r.row, r.col): r.value for r in T.pivot_cells(frame, "r", "c").collect()}
    assert len(count) == 9 and count["t", "c"] == 0.0
    totals = {(r.axis, r.label): r.total for r in T.pivot_totals(T.pivot_cells(frame, "r", "c")).collect()}
    assert totals["all", None] == 4.0 and totals["row", "r"] == 2.0


def test_series_and_trend(spark):
    rows = [("2024-01-03", 1.0), ("2024-01-30", 3.0), ("2024-03-01", 6.0), ("bad", 9.0), (None, 1.0)]
    frame = spark.createDataFrame(rows, "d string, v double")
    assert [(str(r.period_end), r.value) for r in T.time_series(frame, "d", "v").collect()] == [("2024-01-31", 2.0), ("2024-03-31", 6.0)]
    assert [str(r.period_end) for r in T.time_series(frame, "d", "v", "W").collect()] == ["2024-01-07", "2024-02-04", "2024-03-03"]
    assert tuple(T.trend(T.time_series(frame, "d", "v")).first()) == (2, 4.0)
    assert tuple(T.trend(T.time_series(frame.limit(1), "d", "v")).first()) == (1, None)


def test_summary_of_nothing_and_constants(spark):
    frame = spark.createDataFrame([(1.0, "b"), (1.0, "a"), (1.0, None)], "x double, t string")
    rows = {r.field: r for r in T.summary(frame).collect()}
    assert rows["x"].std == 0.0 and rows["t"].top_value == "a" and rows["t"].null_percent == 33.33 and rows["t"].unique_count == 2
    empty = {r.field: r for r in T.summary(frame.limit(0)).collect()}
    assert empty["x"].total_count == 0 and empty["x"].mean is None and empty["t"].top_value is None


def test_distributions(spark):
    flat = spark.createDataFrame([(2.0,)] * 5, "v double")
    assert [tuple(r) for r in T.histogram(flat, "v").collect()] == [(0, 1.5, 2.5, 5)]
    spread = spark.createDataFrame([(float(k),) for k in range(11)] + [(None,)], "v double")
    assert [r.n for r in sorted(T.histogram(spread, "v", 5).collect())] == [2, 2, 2, 2, 3]
    assert T.histogram(spread.limit(0), "v").count() == 0
    stats = T.distribution_stats(spread, "v").first()
    assert stats.n == 11 and stats.skew == 0.0 and round(stats.kurtosis, 4) == -1.2
    tied = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "t string")
    assert [tuple(r) for r in T.value_counts(tied, "t", 2).collect()] == [("a", 2), ("b", 2)]


def test_outliers(spark):
    frame = spark.createDataFrame([(k, float(k % 5)) for k in range(40)] + [(99, 100.0), (100, None)], "id long, v double")
    assert [r.record_id for r in T.outliers(frame, "v", "id").collect()] == [99]
    assert T.outliers(frame.limit(3), "v", "id").count() == 0
    assert T.outlier_stats(frame, "v", "id").first().z_outliers == 1


def test_correlations(spark):
    rows = [(1.0, 2.0, 1.0), (2.0, 4.1, 1.0), (3.0, 5.9, 1.0), (4.0, None, 1.0), (5.0, 10.2, 1.0)]
    frame = spark.createDataFrame(rows, "x double, y double, c double")
    one = T.with_p_value(T.correlation(frame, "x", "y")).first()
    assert one.n == 4 and round(one.r, 4) == 0.9995 and round(one.p_value, 4) == 0.0005
    matrix = {(r.field1, r.field2): (r.r, r.n) for r in T.correlation_matrix(frame).collect()}
    assert matrix["x", "x"] == (1.0, 5) and matrix["x", "c"][0] is None and matrix["x", "y"][1] == 4
    assert T.correlation(frame.limit(2), "x", "y").count() == 0
    assert abs(T.correlation_p(0.5, 10) - 0.14111328125) < 1e-9


def test_registry(spark):
    frame = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "g string, v double")
    assert [tuple(r) for r in registry.run("group-by", frame, group_field="g", value_field="v").collect()] == [("b", 2.0), ("a", 1.0)]
    assert [tuple(r) for r in registry.run("query", frame, filters=[{"field": "v", "operator": "lt", "value": 2}], select=["g"]).collect()] == [("a",)]
    assert registry.run("chart", frame, x_field="g", limit=1).count() == 1
    with pytest.raises(KeyError):
        registry.run("nowhere", frame)
    stages = registry.Pipeline([lambda f: f.where("v > 1"), None, lambda f: f.select("g")])
    assert [tuple(r) for r in stages.run(frame).collect()] == [("b",)]


def test_files():
    page = b"<html><head><title> A  page </title><meta property='og:author' content='Some One'></head><body><nav>menu</nav><h1>Head</h1><p>One &amp; two<br>three</p><script>x()</script></body></html>"
    found = parse_file("a/b.HTML", page)
    assert found["title"] == "A page" and found["author"] == "Some One" and found["content"] == "<h1>Head</h1>\n<p>One &amp; two three</p>"
    mail = b"From: a@b.example\r\nSubject: =?utf-8?q?Gr=C3=BC=C3=9Fe?=\r\nContent-Type: text/plain; charset=utf-8\r\n\r\nline one\r\n\r\nline two\r\n"
    assert parse_file("m.eml", mail)["title"] == "Grüße" and "<p>line two</p>" in parse_file("m.eml", mail)["content"]
    archive = b'Subject: S\r\nContent-Type: multipart/related; boundary="X"; start="<r>"\r\n\r\n--X\r\nContent-Type: text/html\r\nContent-ID: <o>\r\n\r\n<p>' + b"long " * 50 + b"</p>\r\n--X\r\nContent-Type: text/html\r\nContent-ID: <r>\r\n\r\n<p>root</p>\r\n--X--\r\n"
    assert parse_file("w.mht", archive)["content"] == "<p>root</p>" and parse_file("w.mht", archive)["title"] == "S"
    assert parse_file("x.pdf", b"")["error"] and parse_file("noext", b"")["error"] and parse_file("bad.odt", b"no zip")["error"]
    assert parse_file("t.txt", b"a\n\n b ")["content"] == "<p>a</p>\n<p>b</p>"


def test_pushed_filters(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).select("id", (F.col("id") * 2).alias("v"), F.lit("x").alias("t")).write.parquet(path)
    plan = filtered(spark.read.parquet(path), [{"field": "v", "operator": "gt", "value": 10}]).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(v)" in plan and "t#" not in plan.split("ReadSchema")[1]


def test_pivot_of_many_columns_is_whole_or_an_error(spark, monkeypatch):
    frame = spark.range(12_000).selectExpr("id % 3 as r", "id as c")
    cells = T.pivot_cells(frame, "r", "c")
    assert cells.count() == 36_000 and cells.agg({"value": "sum"}).first()[0] == 12_000
    totals = {r.label: r.total for r in T.pivot_totals(T.pivot_filled(frame, "r", "c")).where("axis <> 'col'").collect()}
    assert totals == {"0": 4000, "1": 4000, "2": 4000, None: 12_000}
    monkeypatch.setattr(T, "MAX_GRID", 35_999)
    with pytest.raises(ValueError, match="12000 columns"):
        T.pivot_cells(frame, "r", "c")
