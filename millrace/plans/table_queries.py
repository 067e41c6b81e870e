"""Queries of the table, vector, graph, log and text operators, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, markup, records, scalars, segments, text
from millrace.operators import eventlog, extraction, graph, tabular, vectors
from millrace.plans.predicates import contained, filtered, resolve, selected
from millrace.plans.registry import Query, registrar
from millrace.session import spread
from millrace.sources.readers import DatasetSchema, Field, typed_records
from millrace.streaming import windows

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


query = registrar(QUERIES, ORACLES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    # Work on texts is heavy for its bytes: a table of few splits is spread over all tasks.
    return spread(rows) if name == "documents" else rows


def near(column: str, digits: int) -> Column:
    """Rounded for a comparison; the small offset keeps ties from falling either way."""
    return F.round(F.col(column) + 1e-9, digits).alias(column)


def _near(expression: str, digits: int) -> str:
    return f"round(round({expression}, 6) + 1e-9, {digits})"


# --- grouped values

_SQL_FN = {"mean": "avg", "sum": "sum", "count": "count", "min": "min", "max": "max", "median": "median"}


def _group(fn: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        grouped = tabular.group_values(table(spark, folder, "lineitem"), "l_returnflag", "l_extendedprice", fn)
        return grouped.select("label", near("value", 2))

    sql = f"SELECT l_returnflag AS label, {_near(f'{_SQL_FN[fn]}(l_extendedprice)::DOUBLE', 2)} AS value FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1"
    query(sql, f"group_{fn}")(run)


for _fn in _SQL_FN:
    _group(_fn)


@query("SELECT count(DISTINCT l_returnflag) AS groups, count(*) AS records FROM lineitem")
def group_stats(spark, folder):
    return tabular.group_stats(table(spark, folder, "lineitem"), "l_returnflag", "l_quantity")


@query("SELECT l_returnflag AS label, count(*)::DOUBLE AS value FROM lineitem GROUP BY 1")
def query_group_size(spark, folder):
    return tabular.group_query(table(spark, folder, "lineitem"), "l_returnflag")


@query("SELECT l_shipdate::DATE AS label, round(coalesce(sum(CASE WHEN l_orderkey % 7 <> 0 THEN l_quantity END), 0), 2) AS value FROM lineitem GROUP BY 1")
def query_group_null_sum(spark, folder):
    rows = table(spark, folder, "lineitem").withColumns({"q": F.when(F.col("l_orderkey") % 7 != 0, F.col("l_quantity")), "day": F.col("l_shipdate").cast("date")})
    return tabular.group_query(rows, "day", "q", "sum").select("label", F.round("value", 2).alias("value"))


@query(
    """SELECT coalesce(n.n_name, v.label) AS label, v.value FROM (
  SELECT c_nationkey::VARCHAR AS label, round(round(avg(c_acctbal), 6) + 1e-9, 4) AS value FROM customer WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL GROUP BY 1) v
LEFT JOIN nation n ON n.n_nationkey::VARCHAR = v.label"""
)
def group_fk_label(spark, folder):
    grouped = tabular.group_values(table(spark, folder, "customer"), "c_nationkey", "c_acctbal")
    return tabular.resolve_labels(grouped, table(spark, folder, "nation"), "n_nationkey", "n_name").select("label", near("value", 4))


# --- filters and joins


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def query_filter_eq(spark, folder):
    rows = filtered(table(spark, folder, "orders"), [{"field": "o_orderstatus", "operator": "eq", "value": "F"}])
    return selected(rows, ["o_orderkey", "o_totalprice"], most=None)


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 20.5 AND l_discount >= 0.05 AND l_tax < 0.06")
def query_filter_range(spark, folder):
    rules = [("l_quantity", "gt", 10), ("l_quantity", "lte", "20.5"), ("l_discount", "gte", 0.05), ("l_tax", "lt", 0.06)]
    rows = filtered(table(spark, folder, "lineitem"), [{"field": f, "operator": o, "value": v} for f, o, v in rules])
    return selected(rows, ["l_orderkey", "l_linenumber", "l_quantity"], most=None)


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '(?i)steel|an.*ed')")
def query_filter_contains(spark, folder):
    return selected(filtered(table(spark, folder, "part"), [{"field": "p_type", "operator": "contains", "value": "steel|an.*ed"}]), ["p_partkey", "p_type"], most=None)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND o_orderstatus = 'O'")
def query_filter_combo(spark, folder):
    rules = [
        {"field": "o_orderdate", "operator": "gte", "value": "1997-01-01"},
        {"field": "o_orderdate", "operator": "lt", "value": "1998-01-01"},
        {"field": "o_orderstatus", "value": "O"},
        {"field": "nowhere", "operator": "eq", "value": 1},
        {"field": "o_orderkey", "operator": "unknown", "value": 1},
    ]
    return selected(filtered(table(spark, folder, "orders"), rules), ["o_orderkey", "missing"], most=None)


@query("SELECT * FROM customer ORDER BY c_custkey LIMIT 500")
def query_rows_capped(spark, folder):
    return selected(table(spark, folder, "customer"), order=["c_custkey"])


@query(
    """SELECT o.o_orderkey, c.c_name FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_custkey END AS k FROM orders) o
JOIN (SELECT c_name, CASE WHEN c_custkey <> 1 THEN c_custkey END AS k FROM customer) c ON o.k IS NOT DISTINCT FROM c.k"""
)
def query_join_nullsafe(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey")).alias("k"))
    customers = table(spark, folder, "customer").select("c_name", F.when(F.col("c_custkey") != 1, F.col("c_custkey")).alias("k"))
    return tabular.join_tables(orders, customers, on="k").select("o_orderkey", "c_name")


@query("SELECT n.n_regionkey AS k, n.n_name AS name, r.r_name AS name_r, r.r_name AS name_r2 FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def query_join_three(spark, folder):
    nation = table(spark, folder, "nation").select(F.col("n_regionkey").alias("k"), F.col("n_name").alias("name"))
    region = table(spark, folder, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    return tabular.join_tables(nation, region, region, on="k")


@query(
    """SELECT p_partkey::VARCHAR AS key, p_name AS title, CASE WHEN (SELECT count(*) FROM part WHERE contains(lower(p_name), 'a')) = 1 THEN 'found' ELSE 'ambiguous' END AS outcome
FROM part WHERE contains(lower(p_name), 'a') ORDER BY p_name, p_partkey::VARCHAR LIMIT 10"""
)
def query_resolve(spark, folder):
    return resolve(table(spark, folder, "part"), "A", "p_partkey", "p_name")


@query("SELECT n_name, length(trim(n_name)) >= 2 AND contains(lower('Mail from France and INDIA'), lower(n_name)) AS present FROM nation")
def query_contained(spark, folder):
    return contained(table(spark, folder, "nation").select("n_name"), F.lit("Mail from France and INDIA"), "n_name")


# --- charts and pivots


@query("SELECT o_orderpriority AS label, round(sum(o_totalprice), 2) AS value FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
def chart_top_value(spark, folder):
    return tabular.chart_values(table(spark, folder, "orders"), "o_orderpriority", "o_totalprice", "sum", limit=3).select("label", F.round("value", 2).alias("value"))


@query("SELECT p_brand AS label, count(*)::DOUBLE AS value FROM part WHERE p_size > 10 GROUP BY 1 ORDER BY 1 LIMIT 20")
def chart_label_sort(spark, folder):
    return tabular.chart_values(table(spark, folder, "part"), "p_brand", sort="label", descending=False, filters=[{"field": "p_size", "operator": "gt", "value": 10}])


@query(
    """SELECT count(*) AS categories, min(value) AS least, max(value) AS most, sum(value)::DOUBLE AS total
FROM (SELECT p_brand, count(*)::DOUBLE AS value FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5)"""
)
def chart_stats(spark, folder):
    return tabular.chart_stats(tabular.chart_values(table(spark, folder, "part"), "p_brand", limit=5))


@query("SELECT round(l_quantity, 6) AS x, round(l_extendedprice, 6) AS y FROM lineitem")
def chart_scatter(spark, folder):
    return tabular.scatter(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")


_GRID = """WITH cells AS (SELECT {r} AS row, {c} AS col, {m} AS value FROM {t} GROUP BY 1, 2), kept AS (SELECT * FROM cells WHERE value IS NOT NULL)
SELECT a.row, b.col, coalesce(k.value, 0) AS value FROM (SELECT DISTINCT row FROM kept) a CROSS JOIN (SELECT DISTINCT col FROM kept) b
LEFT JOIN kept k ON k.row = a.row AND k.col = b.col"""


@query(_GRID.format(r="p_brand", c="p_size", m="count(*)::DOUBLE", t="part"))
def pivot_count(spark, folder):
    return tabular.pivot_cells(table(spark, folder, "part"), "p_brand", "p_size")


@query(_GRID.format(r="l_returnflag", c="l_linestatus", m="round(avg(l_discount), 4)", t="lineitem"))
def pivot_mean(spark, folder):
    cells = tabular.pivot_cells(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus", "l_discount", "mean")
    return cells.select("row", "col", F.round("value", 4).alias("value"))


@query(
    f"""WITH grid AS ({_GRID.format(r="p_brand", c="p_size", m="count(*)::DOUBLE", t="part")})
SELECT 'row' AS axis, row::VARCHAR AS label, sum(value)::DOUBLE AS total FROM grid GROUP BY row
UNION ALL SELECT 'col', col::VARCHAR, sum(value)::DOUBLE FROM grid GROUP BY col UNION ALL SELECT 'all', NULL, sum(value)::DOUBLE FROM grid"""
)
def pivot_totals(spark, folder):
    return tabular.pivot_totals(tabular.pivot_filled(table(spark, folder, "part"), "p_brand", "p_size"))


@query(
    """SELECT l_returnflag AS row, round(coalesce(max(CASE WHEN l_linestatus = 'F' THEN l_quantity END), 0), 4) AS "F",
round(coalesce(max(CASE WHEN l_linestatus = 'O' THEN l_quantity END), 0), 4) AS "O" FROM lineitem GROUP BY 1"""
)
def pivot_wide(spark, folder):
    return tabular.pivot_wide(table(spark, folder, "lineitem"), "l_returnflag", "l_linestatus", ["F", "O"], "l_quantity", "max")


# --- series


def _series(name: str, period: str, source: tuple[str, str, str], end: str) -> None:
    t, d, v = source

    def run(spark: SparkSession, folder: str) -> DataFrame:
        return tabular.time_series(table(spark, folder, t), d, v, period).select("period_end", near("value", 4))

    query(f"SELECT {end.format(d=d)} AS period_end, {_near(f'avg({v})', 4)} AS value FROM {t} WHERE {d} IS NOT NULL AND {v} IS NOT NULL GROUP BY 1", name)(run)


_ORDERS = ("orders", "o_orderdate", "o_totalprice")
_series("series_month", "ME", _ORDERS, "last_day({d}::DATE)")
_series("series_quarter", "Q", _ORDERS, "last_day((date_trunc('quarter', {d}) + INTERVAL 2 MONTH)::DATE)")
_series("series_year", "YE", _ORDERS, "make_date(year({d}), 12, 31)")
_series("series_week", "W", _ORDERS, "(date_trunc('week', {d}) + INTERVAL 6 DAY)::DATE")
_series("series_day", "D", ("events", "ts", "value"), "{d}::DATE")
_series("series_hour", "h", ("events", "ts", "value"), "date_trunc('hour', {d})::TIMESTAMP")


@query(
    """SELECT count(*) AS periods, round(regr_slope(value, n), 3) AS slope FROM (
  SELECT value, row_number() OVER (ORDER BY p) - 1 AS n FROM (SELECT last_day(o_orderdate::DATE) AS p, round(avg(o_totalprice), 6) AS value FROM orders GROUP BY 1))"""
)
def series_trend(spark, folder):
    return tabular.trend(tabular.time_series(table(spark, folder, "orders"), "o_orderdate", "o_totalprice")).select("periods", F.round("slope", 3).alias("slope"))


# --- summaries and distributions

_NUMBER_SUMMARY = """SELECT '{f}' AS field, 'number' AS type, count(*) AS total_count, count({f}) AS non_null_count, count(*) - count({f}) AS null_count,
round((count(*) - count({f})) * 100.0 / count(*), 2)::DOUBLE AS null_percent, round(avg({f}), 3) AS mean, round(median({f})::DOUBLE, 3) AS median,
round(stddev_samp({f}), 3) AS std, round(min({f})::DOUBLE, 3) AS min, round(max({f})::DOUBLE, 3) AS max, NULL::BIGINT AS unique_count, NULL::VARCHAR AS top_value,
NULL::VARCHAR AS min_date, NULL::VARCHAR AS max_date FROM {t}"""
_TEXT_SUMMARY = """SELECT '{f}', 'text', count(*), count({f}), count(*) - count({f}), round((count(*) - count({f})) * 100.0 / count(*), 2)::DOUBLE, NULL, NULL, NULL, NULL, NULL,
count(DISTINCT {f}), (SELECT {f} FROM {t} WHERE {f} IS NOT NULL GROUP BY {f} ORDER BY count(*) DESC, {f} LIMIT 1), NULL, NULL FROM {t}"""
_DATE_SUMMARY = """SELECT '{f}', 'date', count(*), count({f}), count(*) - count({f}), round((count(*) - count({f})) * 100.0 / count(*), 2)::DOUBLE, NULL, NULL, NULL, NULL, NULL,
NULL, NULL, strftime(min({f}), '%Y-%m-%d'), strftime(max({f}), '%Y-%m-%d') FROM {t}"""


def _rounded(frame: DataFrame) -> DataFrame:
    return frame.withColumns({c: F.round(c, 3) for c in ("mean", "median", "std", "min", "max")})


@query(" UNION ALL ".join([_NUMBER_SUMMARY.format(f="c_acctbal", t="customer"), _TEXT_SUMMARY.format(f="c_mktsegment", t="customer"), _TEXT_SUMMARY.format(f="c_name", t="customer")]))
def summary_customer(spark, folder):
    return _rounded(tabular.summary(table(spark, folder, "customer"), ["c_acctbal", "c_mktsegment", "c_name"]))


@query(" UNION ALL ".join([_NUMBER_SUMMARY.format(f="o_totalprice", t="orders"), _DATE_SUMMARY.format(f="o_orderdate", t="orders")]))
def summary_orders(spark, folder):
    return _rounded(tabular.summary(table(spark, folder, "orders"), ["o_totalprice", "o_orderdate"]))


@query(" UNION ALL ".join([_NUMBER_SUMMARY.format(f="n_chars", t="documents"), _TEXT_SUMMARY.format(f="lang", t="documents"), _DATE_SUMMARY.format(f="created_at", t="documents")]))
def summary_documents(spark, folder):
    return _rounded(tabular.summary(table(spark, folder, "documents"), ["n_chars", "lang", "created_at"]))


@query(
    """SELECT count(value) AS n, round(avg(value), 4) AS mean, round(median(value), 4) AS median, round(stddev_samp(value), 4) AS std, round(min(value), 4) AS min,
round(max(value), 4) AS max, round(quantile_cont(value, 0.25), 4) AS q25, round(quantile_cont(value, 0.75), 4) AS q75, round(skewness(value), 4) AS skew,
round(kurtosis(value), 4) AS kurtosis FROM events"""
)
def dist_stats(spark, folder):
    found = tabular.distribution_stats(table(spark, folder, "events"), "value")
    return found.select("n", *(F.round(c, 4).alias(c) for c in found.columns[1:]))


_HISTOGRAM = """WITH b AS (SELECT {k} AS k, min({f}) AS lo, max({f}) AS hi FROM {t}), e AS (SELECT k, lo, (hi - lo) / k AS w FROM b),
c AS (SELECT least(floor(({f} - lo) / w)::BIGINT, k - 1)::INT AS bin, count(*) AS n FROM {t}, e WHERE {f} IS NOT NULL GROUP BY 1)
SELECT s.bin::INT AS bin, round(lo + s.bin * w, 4) AS bin_lo, round(lo + (s.bin + 1) * w, 4) AS bin_hi, coalesce(n, 0) AS n
FROM e, (SELECT unnest(range(0, (SELECT max(k) FROM b)::BIGINT)) AS bin) s LEFT JOIN c ON c.bin = s.bin"""


@query(_HISTOGRAM.format(k="10::INT", f="l_extendedprice", t="lineitem"))
def dist_hist_10(spark, folder):
    found = tabular.histogram(table(spark, folder, "lineitem"), "l_extendedprice", 10)
    return found.select("bin", F.round("bin_lo", 4).alias("bin_lo"), F.round("bin_hi", 4).alias("bin_hi"), "n")


_AUTO = """greatest(ceil((max(value) - min(value)) / CASE WHEN quantile_cont(value, 0.75) > quantile_cont(value, 0.25) THEN
least(greatest(2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / pow(count(value), 1.0 / 3), (max(value) - min(value)) / sqrt(count(value)) / 2),
(max(value) - min(value)) / (log2(count(value)) + 1)) ELSE (max(value) - min(value)) / (log2(count(value)) + 1) END), 1)::INT"""


@query(_HISTOGRAM.format(k=_AUTO, f="value", t="events"))
def dist_hist_auto(spark, folder):
    found = tabular.histogram(table(spark, folder, "events"), "value", "auto")
    return found.select("bin", F.round("bin_lo", 4).alias("bin_lo"), F.round("bin_hi", 4).alias("bin_hi"), "n")


@query("SELECT source AS label, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30")
def dist_categorical(spark, folder):
    return tabular.value_counts(table(spark, folder, "documents"), "source")


_FENCE = """WITH s AS (SELECT count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, avg(value) AS m, stddev_samp(value) AS sd FROM events),
b AS (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM s WHERE n >= 4)
"""


@query(_FENCE + f"SELECT event_id AS record_id, {_near('value', 4)} AS value, {_near('abs(value - m) / sd', 4)} AS z, true AS is_outlier FROM events, b WHERE value < low OR value > high")
def outliers_iqr(spark, folder):
    found = tabular.outliers(table(spark, folder, "events"), "value", "event_id")
    return found.select("record_id", near("value", 4), near("z", 4), "is_outlier")


@query(
    _FENCE
    + """SELECT n, round(q1, 4) AS q1, round(q3, 4) AS q3, round(low, 4) AS low, round(high, 4) AS high, count(*) FILTER (value < low OR value > high) AS iqr_outliers,
count(*) FILTER (abs(value - m) / sd > 3) AS z_outliers FROM events, b GROUP BY ALL"""
)
def outliers_stats(spark, folder):
    found = tabular.outlier_stats(table(spark, folder, "events"), "value", "event_id")
    return found.select("n", *(F.round(c, 4).alias(c) for c in ("q1", "q3", "low", "high")), "iqr_outliers", "z_outliers")


@query(
    """SELECT count(*) AS n, round(corr(l_quantity, l_extendedprice), 4) AS r, round(pow(corr(l_quantity, l_extendedprice), 2), 4) AS r_squared,
round(regr_slope(l_extendedprice, l_quantity), 3) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, min(l_quantity) AS x_min, max(l_quantity) AS x_max FROM lineitem"""
)
def corr_pair(spark, folder):
    found = tabular.correlation(table(spark, folder, "lineitem"), "l_quantity", "l_extendedprice")
    return found.withColumns({"r": F.round("r", 4), "r_squared": F.round("r_squared", 4), "slope": F.round("slope", 3), "intercept": F.round("intercept", 3)})


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS field1, '{b}' AS field2, round({'1.0::DOUBLE' if a == b else f'corr({a}, {b})'}, 4) AS r, regr_count({a}, {b})::BIGINT AS n FROM lineitem"
        for i, a in enumerate(_MEASURES)
        for b in _MEASURES[i:]
    )
)
def corr_matrix(spark, folder):
    return tabular.correlation_matrix(table(spark, folder, "lineitem"), _MEASURES).withColumn("r", F.round("r", 4))


@query(
    "SELECT * FROM ("
    + " UNION ALL ".join(f"SELECT '{a}' AS field1, '{b}' AS field2, round(corr({a}, {b}), 4) AS r, count(*) AS n FROM lineitem" for i, a in enumerate(_MEASURES) for b in _MEASURES[i + 1 :])
    + ") ORDER BY abs(r) DESC, field1, field2 LIMIT 3"
)
def corr_strong(spark, folder):
    return tabular.strong_correlations(tabular.correlation_matrix(table(spark, folder, "lineitem"), _MEASURES), 0.0, 3).withColumn("r", F.round("r", 4))


@query()
def corr_pvalue(spark, folder):
    return tabular.with_p_value(tabular.correlation(table(spark, folder, "part"), "p_size", "p_retailprice"))


# --- declared schemas


@query(
    """SELECT event_id AS _id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, NULL::BOOLEAN AS missing FROM events"""
)
def dataset_typed(spark, folder):
    records = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("props").alias("data"))
    return typed_records(records, DatasetSchema((Field("k", "number"), Field("missing", "boolean"))))


# --- vectors

_QUERY_VECTOR = "(SELECT embedding FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"
_COSINE = "list_dot_product(e.embedding::DOUBLE[], q.v::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.v::DOUBLE[], q.v::DOUBLE[])))"
_SCORED = f"WITH q AS (SELECT {_QUERY_VECTOR} AS v), s AS (SELECT vec_id, label, {_COSINE} AS score FROM embeddings e, q)\n"


def _embeddings(spark: SparkSession, folder: str) -> tuple[DataFrame, list[float]]:
    points = table(spark, folder, "embeddings")
    return points, list(points.orderBy("vec_id").select("embedding").first()[0])


@query(_SCORED + "SELECT vec_id, round(score, 5) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def vec_topk(spark, folder):
    points, wanted = _embeddings(spark, folder)
    return vectors.search(points, wanted, 10, key="vec_id", vector="embedding").select("vec_id", F.round("score", 5).alias("score"))


@query(_SCORED + "SELECT vec_id, round(score, 5) AS score FROM s WHERE label = 3 AND s.score >= 0.0 ORDER BY s.score DESC, vec_id LIMIT 1000")
def vec_threshold(spark, folder):
    points, wanted = _embeddings(spark, folder)
    return vectors.search(points, wanted, 1000, 0.0, {"label": 3, "nowhere": 1}, "vec_id", "embedding").select("vec_id", F.round("score", 5).alias("score"))


@query(_SCORED + "SELECT label, round(max(score), 5) AS score, arg_max(vec_id, score) AS vec_id FROM s GROUP BY label ORDER BY 2 DESC, 3 LIMIT 10")
def vec_best_per_label(spark, folder):
    points, wanted = _embeddings(spark, folder)
    scored = points.withColumn("score", vectors.cosine(F.col("embedding"), vectors.literal_vector(wanted))).select("vec_id", "label", "score")
    return vectors.best_per_group(scored, "label", 10, "vec_id").select("label", F.round("score", 5).alias("score"), "vec_id")


@query(
    f"""WITH q AS (SELECT vec_id AS query_id, embedding AS v FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT query_id, vec_id AS id, {_COSINE} AS score FROM embeddings e, q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 5) AS score, rank::INT AS rank FROM r WHERE rank <= 5"""
)
def vec_topk_many(spark, folder):
    points = table(spark, folder, "embeddings")
    asked = points.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.search_many(points, asked, 5, "vec_id", "embedding").withColumn("score", F.round("score", 5))


_CENTROID = """WITH p AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings), m AS (SELECT label, pos, avg(x) AS m FROM p GROUP BY 1, 2),
n AS (SELECT label, sqrt(sum(m * m)) AS len FROM m GROUP BY 1)
"""


@query(_CENTROID + "SELECT m.label, (m.pos - 1)::INT AS pos, round(m / len, 5) AS x FROM m JOIN n ON n.label = m.label")
def vec_centroid(spark, folder):
    found = vectors.centroids(table(spark, folder, "embeddings"), "label", "embedding")
    return found.select("label", F.posexplode("centroid").alias("pos", "x")).select("label", "pos", F.round("x", 5).alias("x"))


@query(
    _CENTROID
    + """, c AS (SELECT e.vec_id, e.label, sum(x * m / len) AS s FROM (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) e
JOIN m ON m.label = e.label AND m.pos = e.pos JOIN n ON n.label = e.label GROUP BY 1, 2),
l AS (SELECT vec_id, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS len FROM embeddings)
SELECT c.vec_id, c.label, row_number() OVER (PARTITION BY c.label ORDER BY s / l.len DESC, c.vec_id)::INT AS rank FROM c JOIN l ON l.vec_id = c.vec_id"""
)
def vec_centrality(spark, folder):
    points = table(spark, folder, "embeddings")
    return vectors.by_centrality(points, vectors.centroids(points, "label", "embedding"), "label", "vec_id", "embedding").select("vec_id", "label", "rank")


@query(
    """SELECT doc_id, score FROM (SELECT doc_id, text, n_chars % 97 AS score, row_number() OVER (PARTITION BY text ORDER BY n_chars % 97 DESC, doc_id) AS n
FROM documents WHERE trim(text, ' ') <> '') WHERE n = 1"""
)
def vec_rerank_dedupe(spark, folder):
    hits = table(spark, folder, "documents").select("doc_id", "text", (F.col("n_chars") % 97).alias("score"))
    return vectors.reranked(hits, "text", "doc_id").select("doc_id", "score")


@query()
def vec_distinct_greedy(spark, folder):
    points = table(spark, folder, "rag_chunks").where("source_id is not null and vector is not null").select("source_id", "id", "vector")
    return vectors.distinct_greedy(points, "source_id", "id", "vector", 0.9).select("source_id", "id")


@query(
    """SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 99 ELSE label END::INT AS label FROM embeddings
UNION ALL SELECT vec_id + 100000, 98 FROM embeddings WHERE vec_id % 5 = 0"""
)
def vec_upsert(spark, folder):
    stored = table(spark, folder, "embeddings").select("vec_id", "label")
    changed = stored.where("vec_id % 3 = 0").select("vec_id", F.lit(99).alias("label"))
    added = stored.where("vec_id % 5 = 0").select((F.col("vec_id") + 100000).alias("vec_id"), F.lit(98).alias("label"))
    return vectors.upserted(stored, changed.unionByName(added).unionByName(added), ["vec_id"])


@query("SELECT vec_id FROM embeddings WHERE label <> 3 AND vec_id % 4 <> 0")
def vec_delete(spark, folder):
    stored = table(spark, folder, "embeddings").select("vec_id", "label")
    left = vectors.deleted(stored, label=3, nowhere=1)
    return vectors.deleted_keys(left, stored.where("vec_id % 4 = 0"), ["vec_id"]).select("vec_id")


@query("SELECT id, source_type FROM rag_chunks WHERE source_type = 'doc' AND id IN (SELECT id FROM rag_chunks WHERE project_id = '2')")
def vec_by_ids(spark, folder):
    chunks = table(spark, folder, "rag_chunks").select("id", "source_type", "project_id")
    return vectors.by_ids(vectors.matching(chunks, {"source_type": "doc"}), chunks.where("project_id = '2'"), "id").select("id", "source_type")


@query("SELECT doc_id FROM documents WHERE source = 'inbox_sync' ORDER BY created_at DESC NULLS LAST, doc_id DESC LIMIT 10")
def recent_entries(spark, folder):
    return vectors.recent(table(spark, folder, "documents"), "source", "inbox_sync", key="doc_id").select("doc_id")


@query(
    _SCORED
    + """, hits AS (SELECT vec_id AS id, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM s ORDER BY score DESC, vec_id LIMIT 8),
r AS (SELECT doc_id AS id, row_number() OVER (ORDER BY created_at DESC NULLS LAST, doc_id DESC) AS rank FROM documents WHERE source = 'inbox_sync' ORDER BY rank LIMIT 15)
SELECT * FROM (SELECT id, rank::INT AS rank, 0 AS src FROM hits UNION ALL SELECT id, rank::INT, 1 FROM r WHERE id NOT IN (SELECT id FROM hits)) ORDER BY src, rank LIMIT 12"""
)
def memory_hits_recent(spark, folder):
    """The points most like the first one, then the newest documents of a source."""
    from pyspark.sql import Window

    points, wanted = _embeddings(spark, folder)
    hits = vectors.search(points, wanted, 8, key="vec_id", vector="embedding")
    newest = vectors.recent(table(spark, folder, "documents"), "source", "inbox_sync", key="doc_id", most=15)
    # Both are a few rows by now, so that a window over all of them is no bottleneck.
    hits = hits.select(F.col("vec_id").alias("id"), F.row_number().over(Window.orderBy(F.desc("score"), "vec_id")).alias("rank"))
    newest = newest.select(F.col("doc_id").alias("id"), F.row_number().over(Window.orderBy(F.desc_nulls_last("created_at"), F.desc("doc_id"))).alias("rank"))
    return vectors.with_recent(hits, newest)


# --- graphs


def _graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Nations in regions and suppliers in nations as entities and relations."""
    region, nation, supplier = (table(spark, folder, t) for t in ("region", "nation", "supplier"))
    entities = (
        region.select(F.concat(F.lit("r"), "r_regionkey").alias("entity_id"), F.col("r_name").alias("name"), F.lit("region").alias("entity_type"), F.lit(1).alias("project_id"))
        .unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("entity_id"), F.col("n_name").alias("name"), F.lit("nation").alias("entity_type"), F.lit(1).alias("project_id")))
        .unionByName(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("entity_id"), F.col("s_name").alias("name"), F.lit("supplier").alias("entity_type"), F.lit(2).alias("project_id")))
    )
    relations = nation.select(
        F.concat(F.lit("n"), "n_nationkey").alias("src_id"), F.lit("in_region").alias("predicate"), F.concat(F.lit("r"), "n_regionkey").alias("dst_id"), F.lit(1).alias("resource_id"), F.lit(1).alias("project_id")
    ).unionByName(
        supplier.select(
            F.concat(F.lit("s"), "s_suppkey").alias("src_id"), F.lit("based_in").alias("predicate"), F.concat(F.lit("n"), "s_nationkey").alias("dst_id"), (F.col("s_suppkey") % 3).cast("int").alias("resource_id"), F.lit(2).alias("project_id")
        )
    )
    return entities, relations


_GRAPH = """WITH RECURSIVE ent AS (SELECT 'r' || r_regionkey AS id, r_name AS name FROM region UNION ALL SELECT 'n' || n_nationkey, n_name FROM nation UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier),
rel AS (SELECT 'n' || n_nationkey AS src_id, 'in_region' AS predicate, 'r' || n_regionkey AS dst_id, 1 AS resource_id, 1 AS project_id FROM nation
  UNION ALL SELECT 's' || s_suppkey, 'based_in', 'n' || s_nationkey, (s_suppkey % 3)::INT, 2 FROM supplier),
link AS (SELECT src_id AS a, dst_id AS b FROM rel UNION SELECT dst_id, src_id FROM rel)
"""


@query(
    _GRAPH
    + """SELECT s.name AS subject, predicate, o.name AS object, resource_id FROM rel JOIN ent s ON s.id = src_id JOIN ent o ON o.id = dst_id WHERE resource_id IN (1, 2) AND project_id = 2
ORDER BY 1, 2, 3, src_id, dst_id, resource_id LIMIT 200"""
)
def graph_one_hop(spark, folder):
    entities, relations = _graph(spark, folder)
    return graph.inventory(relations, entities, [1, 2], 2).select("subject", "predicate", "object", "resource_id")


@query(
    _GRAPH
    + """, near(id, d) AS (SELECT id, 0 FROM ent WHERE name = (SELECT min(n_name) FROM nation) UNION SELECT link.b, d + 1 FROM near JOIN link ON link.a = near.id WHERE d < 1),
dist AS (SELECT id, min(d) AS d FROM near GROUP BY 1)
SELECT rel.src_id, rel.predicate, rel.dst_id, least(a.d, b.d)::INT AS dist FROM rel LEFT JOIN dist a ON a.id = src_id LEFT JOIN dist b ON b.id = dst_id WHERE least(a.d, b.d) IS NOT NULL"""
)
def graph_neighborhood_2(spark, folder):
    entities, relations = _graph(spark, folder)
    name = table(spark, folder, "nation").agg(F.min("n_name")).first()[0]
    return graph.neighbourhood(relations, entities, [name], 2, limit=None).select("src_id", "predicate", "dst_id", "dist")


@query(_GRAPH + "SELECT src_id, CASE WHEN src_id = 'n1' THEN 'lies_in' ELSE predicate END AS predicate, dst_id FROM rel WHERE resource_id <> 2")
def graph_mutations(spark, folder):
    _, relations = _graph(spark, folder)
    target = table(spark, folder, "nation").where("n_nationkey = 1").select(F.concat(F.lit("r"), "n_regionkey")).first()[0]
    changed = graph.change_predicate(relations, "n1", "in_region", target, 1, "Lies in")
    return graph.delete_resource(changed, 2).select("src_id", "predicate", "dst_id")


@query(_GRAPH + "SELECT id AS entity_id, CASE WHEN left(id, 1) = 'r' THEN upper(name) || '!' ELSE name END AS name FROM ent")
def graph_upsert(spark, folder):
    entities, _ = _graph(spark, folder)
    fresh = entities.where("entity_type = 'region'").withColumn("name", F.concat(F.upper("name"), F.lit("!")))
    return graph.upsert_entities(entities, fresh).select("entity_id", "name")


@query(
    """SELECT subject, predicate, object, confidence FROM (SELECT c_mktsegment AS subject, 'deals_with' AS predicate, n_name AS object, c_acctbal AS confidence, c_custkey AS pos,
row_number() OVER (PARTITION BY c_mktsegment, n_name ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE k = 1"""
)
def relations_valid(spark, folder):
    customer, nation = table(spark, folder, "customer"), table(spark, folder, "nation")
    found = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_mktsegment").alias("subject"), F.lit("Deals with").alias("predicate"), F.col("n_name").alias("object"), F.col("c_acctbal").alias("confidence"), F.lit("").alias("context"), F.col("c_custkey").alias("pos")
    )
    names = customer.select(F.col("c_mktsegment").alias("name")).union(nation.select("n_name")).distinct()
    return graph.valid_relations(found.union(found.withColumn("object", F.lit("nowhere"))), names).select("subject", "predicate", "object", "confidence")


# --- queue and log


@query(
    """SELECT execution_id FROM executions WHERE status = 'queued' AND available_at <= TIMESTAMP '2030-01-01 12:00:00' AND (priority IN ('high', 'normal') OR (priority = 'background'
AND NOT EXISTS (SELECT 1 FROM executions WHERE status = 'queued' AND priority IN ('high', 'normal')))) ORDER BY CASE priority WHEN 'high' THEN 0 WHEN 'normal' THEN 1 ELSE 2 END,
available_at, created_at NULLS LAST, execution_id LIMIT 100"""
)
def queue_claim_order(spark, folder):
    return eventlog.claim_order(table(spark, folder, "executions"), F.lit("2030-01-01 12:00:00").cast("timestamp_ntz")).select("execution_id")


@query("SELECT priority, count(*) AS n FROM executions WHERE status = 'queued' GROUP BY 1")
def queue_counts(spark, folder):
    return eventlog.queue_counts(table(spark, folder, "executions"))


@query(
    """SELECT *, last_sequence - first_sequence + 1 = n_sequences AS contiguous, n_events = n_sequences AS unique FROM (
SELECT root_execution_id, count(DISTINCT event_id) AS n_events, min(sequence) AS first_sequence, max(sequence) AS last_sequence, count(DISTINCT sequence) AS n_sequences,
count(DISTINCT producer_instance_id) AS n_producers, count(DISTINCT execution_id) AS n_executions FROM execution_events WHERE root_execution_id IS NOT NULL GROUP BY 1)"""
)
def log_summary(spark, folder):
    return eventlog.log_summary(table(spark, folder, "execution_events"))


@query(
    """SELECT root_execution_id, sequence AS after_sequence, nxt AS next_sequence FROM (SELECT root_execution_id, sequence, lead(sequence) OVER (PARTITION BY root_execution_id ORDER BY sequence) AS nxt
FROM (SELECT DISTINCT root_execution_id, sequence FROM execution_events WHERE root_execution_id IS NOT NULL AND sequence IS NOT NULL)) WHERE nxt > sequence + 1"""
)
def log_gaps(spark, folder):
    return eventlog.sequence_gaps(table(spark, folder, "execution_events"))


_ONE = "(SELECT event_id, min(root_execution_id) AS root, min(sequence) AS seq, min(caused_by_event_id) AS cause FROM execution_events WHERE event_id IS NOT NULL GROUP BY 1)"


@query(
    f"""SELECT * FROM (SELECT e.event_id, CASE WHEN c.root IS NULL OR c.root <> e.root THEN 'unknown_cause' WHEN c.seq >= e.seq THEN 'cause_not_before' END AS problem
FROM {_ONE} e LEFT JOIN {_ONE} c ON e.cause = c.event_id WHERE e.cause IS NOT NULL) WHERE problem IS NOT NULL"""
)
def log_causes(spark, folder):
    return eventlog.cause_violations(table(spark, folder, "execution_events"))


@query(
    """SELECT event_id FROM (SELECT event_id, p, lag(p) OVER (PARTITION BY r, c, i ORDER BY s, event_id) AS last FROM (SELECT event_id, min(root_execution_id) AS r, min(producer_component) AS c,
min(producer_instance_id) AS i, min(sequence) AS s, min(producer_sequence) AS p FROM execution_events WHERE event_id IS NOT NULL AND sequence IS NOT NULL AND producer_sequence IS NOT NULL GROUP BY 1)) WHERE p <= last"""
)
def log_producer_order(spark, folder):
    return eventlog.producer_order(table(spark, folder, "execution_events"))


@query(
    """SELECT DISTINCT root_execution_id, operation_id FROM execution_events s WHERE event_type = 'operation.started' AND operation_id IS NOT NULL AND NOT EXISTS (
SELECT 1 FROM execution_events f WHERE f.event_type = 'operation.finished' AND f.root_execution_id = s.root_execution_id AND f.operation_id = s.operation_id)"""
)
def log_open_operations(spark, folder):
    return eventlog.open_operations(table(spark, folder, "execution_events"))


@query("SELECT root_execution_id, producer_component, producer_instance_id, coalesce(max(producer_sequence), 0) + 1 AS next_sequence FROM execution_events GROUP BY 1, 2, 3")
def log_next_sequence(spark, folder):
    return eventlog.next_producer_sequence(table(spark, folder, "execution_events"))


@query(
    """SELECT execution_id, event_type, sequence FROM (SELECT *, row_number() OVER (PARTITION BY execution_id ORDER BY sequence DESC, event_id DESC, event_type DESC) AS k
FROM execution_events WHERE execution_id IS NOT NULL AND sequence IS NOT NULL) WHERE k = 1"""
)
def log_latest_state(spark, folder):
    return eventlog.latest_state(table(spark, folder, "execution_events"))


@query("SELECT event_id, min(ingested_at) AS ingested_at FROM execution_events WHERE event_id IS NOT NULL GROUP BY 1")
def log_dedupe(spark, folder):
    return eventlog.deduplicated(table(spark, folder, "execution_events").drop("envelope")).select("event_id", "ingested_at")


@query("SELECT event_id, count(DISTINCT content_hash) AS n_hashes FROM execution_events WHERE event_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT content_hash) > 1")
def log_hash_breaks(spark, folder):
    return eventlog.hash_chain_breaks(table(spark, folder, "execution_events"))


@query(
    """SELECT DISTINCT e.event_id FROM execution_events e JOIN executions x ON e.execution_id = x.execution_id AND e.attempt_id = x.attempt_id"""
)
def log_fenced(spark, folder):
    return eventlog.fenced(table(spark, folder, "execution_events"), table(spark, folder, "executions")).select("event_id").distinct()


@query(
    """WITH log AS (SELECT * FROM execution_events WHERE sequence % 5 <> 0), fresh AS (SELECT event_id, min(root_execution_id) AS r, min(producer_component) AS c, min(producer_instance_id) AS i, min(occurred_at) AS o
FROM execution_events WHERE sequence % 5 = 0 AND event_id NOT IN (SELECT event_id FROM log) GROUP BY 1),
root AS (SELECT root_execution_id AS r, max(sequence) AS s, arg_max(event_id, (sequence, event_id)) AS e FROM log GROUP BY 1),
own AS (SELECT root_execution_id AS r, producer_component AS c, producer_instance_id AS i, max(producer_sequence) AS p FROM log GROUP BY 1, 2, 3)
SELECT event_id, coalesce(root.s, 0) + row_number() OVER a AS sequence, coalesce(own.p, 0) + row_number() OVER b AS producer_sequence, coalesce(lag(event_id) OVER a, root.e) AS caused_by_event_id
FROM fresh LEFT JOIN root ON root.r = fresh.r LEFT JOIN own ON own.r = fresh.r AND own.c = fresh.c AND own.i = fresh.i
WINDOW a AS (PARTITION BY fresh.r ORDER BY o NULLS FIRST, event_id), b AS (PARTITION BY fresh.r, fresh.c, fresh.i ORDER BY o NULLS FIRST, event_id)"""
)
def log_append(spark, folder):
    events = table(spark, folder, "execution_events")
    fresh = events.where("sequence % 5 = 0").select("event_id", "root_execution_id", "producer_component", "producer_instance_id", "event_type", "occurred_at", F.lit("{}").alias("payload"))
    return eventlog.appended(events.where("sequence % 5 <> 0"), fresh).select("event_id", "sequence", "producer_sequence", "caused_by_event_id")


# --- streams, as batches


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, folder):
    found = windows.tumbling(table(spark, folder, "events"), "ts", "1 hour", ["event_type"])
    return found.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query(
    """SELECT window_start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT event_type, value, unnest([date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts)])::TIMESTAMP AS window_start FROM events) GROUP BY 1, 2"""
)
def stream_sliding(spark, folder):
    found = windows.sliding(table(spark, folder, "events"), "ts", "2 hours", "1 hour", ["event_type"], "value")
    return found.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 2).alias("total"))


@query(
    """WITH s AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM g GROUP BY user_id, k"""
)
def stream_sessions(spark, folder):
    found = windows.sessions(table(spark, folder, "events"), "ts", "6 hours", "user_id")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@query("SELECT DISTINCT event_id FROM execution_events")
def stream_once(spark, folder):
    return windows.once(table(spark, folder, "execution_events"), "ingested_at", ["event_id"]).select("event_id")


# --- scalars


@query(
    """SELECT doc_id, 'source:' || source AS owner, 'doc_' || doc_id AS source_key, 'passage: ' || lang AS passage, CASE WHEN length(trim(doc_kind, ' ')) > 3 THEN left(trim(doc_kind, ' '), 3) || '…' ELSE trim(doc_kind, ' ') END AS short
FROM documents"""
)
def scalar_labels(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select(
        "doc_id",
        F.when(F.col("source").isNotNull(), scalars.owner_tag(F.lit("source"), "source")).alias("owner"),
        scalars.source_key(F.lit("note"), "doc_id").alias("source_key"),
        scalars.embedding_prefix("lang").alias("passage"),
        scalars.cut_text("doc_kind", 3).alias("short"),
    )


@query(
    """SELECT event_id, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad(((s % 3600) // 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0')
ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS duration FROM (SELECT event_id, floor(value * 20)::BIGINT AS s FROM events)"""
)
def scalar_durations(spark, folder):
    return table(spark, folder, "events").select("event_id", scalars.duration_text(F.col("value") * 20).alias("duration"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(lang, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)\\s*$') THEN lang END AS as_number, CASE WHEN lower(trim(lang, ' ')) IN ('true', 'yes', 't', 'y', '1') THEN 'true'
WHEN lower(trim(lang, ' ')) IN ('false', 'no', 'f', 'n', '0') THEN 'false' END AS as_boolean, nullif(trim(lang, ' '), '') AS as_text, strftime(created_at, '%Y-%m-%d') AS as_date FROM documents"""
)
def scalar_cells(spark, folder):
    rows = table(spark, folder, "documents")
    return rows.select(
        "doc_id",
        scalars.typed_cell("lang", "number").alias("as_number"),
        scalars.typed_cell("lang", "boolean").alias("as_boolean"),
        scalars.typed_cell("lang", "text").alias("as_text"),
        scalars.typed_cell(F.col("created_at").cast("string"), "date").alias("as_date"),
    )


@query("SELECT execution_id, coalesce(retry_count BETWEEN -10080 AND 0, true) AND coalesce(starts_with(priority, 'FREQ='), true) AS valid FROM executions")
def scalar_reminders(spark, folder):
    return table(spark, folder, "executions").select("execution_id", scalars.reminder_valid("retry_count", "priority").alias("valid"))


# --- texts

_TOKENS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"


@query(f"SELECT doc_id, len({_TOKENS.format('text')})::INT AS words FROM documents WHERE text IS NOT NULL")
def text_wordcount(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.word_count("text").alias("words"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+'))::INT AS words FROM documents WHERE text IS NOT NULL")
def text_letterwords(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.letter_word_count("text").alias("words"))


_LINES = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query(
    f"""SELECT doc_id, count(*) FILTER (len({_TOKENS.format("line")}) >= 4 OR length(regexp_replace(line, '[^\\p{{L}}\\p{{N}}]', '', 'g')) >= 16) AS kept, count(*) AS lines FROM {_LINES} GROUP BY 1"""
)
def text_minlen(spark, folder):
    return _lines(spark, folder).groupBy("doc_id").agg(F.count_if(text.long_enough("line")).alias("kept"), F.count(F.lit(1)).alias("lines"))


@query(
    f"""SELECT doc_id, line FROM {_LINES} WHERE length(regexp_replace(line, '\\s', '', 'g')) > 0
AND length(regexp_replace(line, '{text._NO_SYMBOL.replace(chr(39), chr(39) * 2)}', '', 'g')) / length(regexp_replace(line, '\\s', '', 'g')) > 0.3"""
)
def text_symbols(spark, folder):
    return _lines(spark, folder).where(~text.few_symbols("line") & (F.length(F.regexp_replace("line", r"\s", "")) > 0))


@query(
    f"""SELECT doc_id, line FROM {_LINES} WHERE length(regexp_replace(line, '\\s', '', 'g')) > 0 AND coalesce(list_sum(list_transform(
regexp_extract_all(line, '\\[[^\\]]*\\]\\([^)]*\\)|https?://\\S+'), lambda x: length(regexp_replace(x, '\\s', '', 'g')))), 0) / length(regexp_replace(line, '\\s', '', 'g')) > 0.5"""
)
def text_links(spark, folder):
    return _lines(spark, folder).where(~text.few_links("line") & (F.length(F.regexp_replace("line", r"\s", "")) > 0))


@query(
    f"""SELECT doc_id FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x, ' ') <> '') AS l FROM documents WHERE regexp_matches(text, '\\S'))
WHERE len(l) > 0 AND len(list_filter(l, lambda x: regexp_matches(x, '{text.BULLET}'))) / len(l) > 0.9"""
)
def text_bullets(spark, folder):
    return table(spark, folder, "documents").where(r"text rlike '\\S'").where(~text.few_bullets("text")).select("doc_id")


@query(
    f"""SELECT doc_id, unit FROM (SELECT doc_id, pos, unit, row_number() OVER (PARTITION BY doc_id, lower(trim(regexp_replace(unit, '\\s+', ' ', 'g'), ' ')) ORDER BY pos) AS n FROM (
SELECT doc_id, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents WHERE text IS NOT NULL)) WHERE n = 1"""
)
def text_dedup(spark, folder):
    units = table(spark, folder, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "unit"))
    return text.filter_units(units, ["dedup", "no_such_filter"]).select("doc_id", "unit")


@query()
def text_web_filters(spark, folder):
    return text.filter_units(segments.units(table(spark, folder, "documents")), ["web"]).select("doc_id", "pos", "unit")


@query()
def text_aux_heading(spark, folder):
    return text.relevant_units(segments.units(table(spark, folder, "documents"))).select("doc_id", "pos", "unit")


_REDACTED = """regexp_replace(regexp_replace(regexp_replace(text, '<think>.*?</think>', '', 'gsi'), '\\bbearer\\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'gi'),
'\\b(access[_-]?token|api[_-]?key|auth[_-]?token|authorization|cookie|id[_-]?token|password|refresh[_-]?token|session[_-]?token|token)\\s*[:=]\\s*([^\\s,;]+)', '\\1=[REDACTED]', 'gi')"""


@query(f"SELECT doc_id, {_REDACTED} AS text FROM documents WHERE text IS NOT NULL")
def text_redact(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.redacted("text").alias("text"))


@query("SELECT doc_id, regexp_replace(regexp_replace(text, 'data:[a-zA-Z0-9+./;=-]*;base64,[A-Za-z0-9+/=\\s]+', '[image]', 'g'), '\\S{1000}\\S{1000}\\S*', '[blob]', 'g') AS text FROM documents WHERE text IS NOT NULL")
def text_blobs(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.without_blobs("text").alias("text"))


@query(
    f"""SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '\\r?\\n'), lambda x: trim(x, ' ')), lambda x: x <> '').list_transform(lambda x: '<p>' || x || '</p>').array_to_string(chr(10)) AS content
FROM documents WHERE text IS NOT NULL"""
)
def text_paragraphs(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.paragraphs_html("text").alias("content"))


_SENTENCES = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"


@query(
    f"""WITH s AS (SELECT doc_id, unnest({_SENTENCES.format("text")}) AS sentence, generate_subscripts({_SENTENCES.format("text")}, 1) AS pos FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, sentence AS point, min(pos) AS pos FROM s WHERE len({_TOKENS.format("sentence")}) BETWEEN 3 AND 10 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rank FROM p) SELECT doc_id, rank::INT AS rank, point FROM r WHERE rank <= 5"""
)
def text_point_fallback(spark, folder):
    return extraction.fallback_points(table(spark, folder, "documents"))


@query(
    f"""WITH s AS (SELECT doc_id, unnest({_SENTENCES.format("text")}) AS sentence, generate_subscripts({_SENTENCES.format("text")}, 1) AS pos FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, pos, array_to_string({_TOKENS.format("sentence")}[1:6], ' ') AS k FROM s),
g AS (SELECT doc_id, lower(k) AS low, count(*) AS n, min(pos) AS first, arg_min(k, pos) AS keyword FROM w WHERE k <> '' GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM g) SELECT doc_id, rank::INT AS rank, keyword, n FROM r WHERE rank <= 10"""
)
def text_keyword_fallback(spark, folder):
    return extraction.fallback_keywords(table(spark, folder, "documents"))


@query("SELECT doc_id, 'sha256:' || sha256('{\"doc_id\":' || doc_id || ',\"text\":' || to_json(text)::VARCHAR || '}') AS hash FROM documents WHERE text IS NOT NULL")
def doc_hash(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.content_hash("text", "doc_id").alias("hash"))


@query()
def text_search_terms(spark, folder):
    return table(spark, folder, "eval_items").select("item_id", text.search_terms("item_text").alias("terms"))


@query()
def text_preview(spark, folder):
    return table(spark, folder, "documents").where("text is not null").select("doc_id", text.preview("text").alias("preview"))


@query()
def text_chunks_overlap(spark, folder):
    return segments.chunked(table(spark, folder, "documents"))


@query()
def text_chunks_greedy(spark, folder):
    return segments.exploded(table(spark, folder, "documents"), segments.greedy_chunks)


@query()
def text_units(spark, folder):
    return segments.units(table(spark, folder, "documents"))


@query()
def text_chunks_built(spark, folder):
    return segments.built_chunks(table(spark, folder, "documents"), ["web"], 300)


@query()
def html_blocks(spark, folder):
    return table(spark, folder, "documents").where("text like '%<%'").select("doc_id", F.posexplode(markup.to_blocks("text")).alias("pos", "block"))


@query()
def html_markdown(spark, folder):
    return table(spark, folder, "documents").where("text like '%<%'").select("doc_id", markup.to_markdown("text").alias("markdown"))


_PADDED = "' ' || lower(e.expression) || ' '"


def _bounded(pattern: str) -> str:
    """A pattern between edges of words, over padded text; no look-around, which DuckDB hasn't."""
    return f"regexp_matches({_PADDED}, '[^\\p{{L}}\\p{{N}}_](?:{pattern.replace(chr(39), chr(39) * 2)})[^\\p{{L}}\\p{{N}}_]')"


_NUMERIC_DATE = r"\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2}"
_ABSOLUTE = " OR ".join(map(_bounded, ("1[0-9]{3}|2[0-9]{3}", _NUMERIC_DATE, "|".join(w for words in dates.MONTHS.values() for w in words.split()), "|".join(dates.WEEKDAYS))))
_RELATIVE = f"{_bounded('|'.join(dates.STANDALONE_WORDS))} OR ({_bounded('|'.join(dates.MARKERS))} AND {_bounded('|'.join(dates.TIME_UNITS))})"
_MONTH_NAMED, _YEAR_NAMED, _DAY_NAMED = map(_bounded, ("|".join(w for words in dates.MONTHS.values() for w in words.split()), "1[0-9]{3}|2[0-9]{3}", r"0?[1-9]|[12]\d|3[01]"))


@query(
    f"""WITH e AS (SELECT DISTINCT doc_id, unnest({_SENTENCES.format("text")}) AS expression FROM documents WHERE text IS NOT NULL)
SELECT * FROM (SELECT doc_id, expression, CASE WHEN {_ABSOLUTE} THEN 'absolute' WHEN {_RELATIVE} THEN 'relative' END AS kind,
CASE WHEN {_bounded(_NUMERIC_DATE)} THEN 'day' WHEN {_MONTH_NAMED} AND {_YEAR_NAMED} AND NOT {_DAY_NAMED} THEN 'month' WHEN {_YEAR_NAMED} AND NOT {_MONTH_NAMED} THEN 'year' ELSE 'day' END AS "precision"
FROM e) WHERE kind IS NOT NULL"""
)
def date_classify(spark, folder):
    """Every sentence that names a date, by the kind of date and its precision."""
    found = table(spark, folder, "documents").where("text is not null").select("doc_id", F.explode(text.sentences("text")).alias("expression")).distinct()
    return found.select("doc_id", "expression", dates.kind_of("expression").alias("kind"), dates.precision_of("expression").alias("precision")).where("kind is not null")


@query()
def date_resolve(spark, folder):
    """Every date expression of the texts in any form the rules know, with its place and the day it means as of the document."""
    rows = table(spark, folder, "documents").where("text is not null").select("doc_id", F.col("created_at").cast("date").alias("day"), "text", F.explode(F.array_distinct(dates.expressions("text"))).alias("expression"))
    first, last = dates.resolved_range("expression", "day")
    return rows.select("doc_id", "expression", dates.located("text", "expression").alias("offset"), first.alias("resolved"), last.alias("resolved_end"))


@query()
def date_merged(spark, folder):
    """The dates of each text without repeats, in the order of time."""
    found = date_resolve(spark, folder).select("doc_id", F.col("expression").alias("raw"), F.col("resolved").alias("start"), "offset")
    return dates.merged_dates(found)


@query("SELECT execution_id, 'sha256:' || sha256(input) AS hash FROM (SELECT DISTINCT execution_id, '{\"id\":\"' || execution_id || '\",\"n\":' || step || '}' AS input FROM executions WHERE step IS NOT NULL)")
def record_hash(spark, folder):
    rows = table(spark, folder, "executions").where("step is not null").select("execution_id", F.to_json(F.struct(F.col("step").alias("n"), F.col("execution_id").alias("id"))).alias("j")).distinct()
    return rows.select("execution_id", records.to_content_hash("j").alias("hash"))


@query()
def record_redacted(spark, folder):
    return table(spark, folder, "execution_events").where("envelope is not null").select("event_id", records.to_redacted_json("envelope").alias("envelope"))


# --- conversations, from the messages of chat executions


def _turns(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "executions").where("task_type = 'assistant_chat' and payload is not null").select("execution_id", "payload").dropDuplicates(["execution_id"])
    messages = F.from_json(F.get_json_object("payload", "$.messages"), "array<struct<role string, content string>>")
    return rows.select(F.col("execution_id").alias("conv_id"), F.posexplode(messages).alias("turn", "m")).select("conv_id", "turn", "m.role", F.col("m.content").alias("text"))


@query()
def chat_last_turns(spark, folder):
    return extraction.last_turns(_turns(spark, folder), 4)


@query()
def chat_last_user(spark, folder):
    return extraction.last_user_message(_turns(spark, folder))
