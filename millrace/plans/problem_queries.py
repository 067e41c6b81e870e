"""Queries of the core problems (late events, hierarchies, nested records) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import flatten, hierarchy, late_events


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return late_events.late_found(table(spark, folder, "execution_events"))


def p1_hours(spark: SparkSession, folder: str) -> DataFrame:
    return late_events.corrected_hours(table(spark, folder, "execution_events"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.hierarchy_findings(table(spark, folder, "executions"))


def p2_paths(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.hierarchy_paths(table(spark, folder, "executions"))


def p2_descendants(spark: SparkSession, folder: str) -> DataFrame:
    return hierarchy.descendant_links(table(spark, folder, "executions"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    payloads = flatten.list_elements(table(spark, folder, "executions"), "execution_id", "payload")
    return payloads.unionByName(flatten.list_elements(table(spark, folder, "execution_events"), "event_id", "envelope"))


def p5_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables of payloads and of envelopes; ``source`` and table_name name a table."""
    payloads = flatten.flat_tables(table(spark, folder, "executions"), "execution_id", "payload").withColumn("source", F.lit("executions.payload"))
    envelopes = flatten.flat_tables(table(spark, folder, "execution_events"), "event_id", "envelope").withColumn("source", F.lit("execution_events.envelope"))
    return payloads.unionByName(envelopes)


P1_CTE = """
WITH firsts AS (
  SELECT event_id, min(struct_pack(a := ingested_at, o := occurred_at, r := root_execution_id)) AS e
  FROM execution_events
  WHERE event_id IS NOT NULL AND root_execution_id IS NOT NULL AND ingested_at IS NOT NULL AND occurred_at IS NOT NULL
  GROUP BY event_id),
ev AS (SELECT event_id, e.r AS root, epoch_us(e.a) AS a, least(epoch_us(e.o), epoch_us(e.a)) AS t FROM firsts),
steps AS (
  SELECT root, a, max(m) OVER (PARTITION BY root ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mark
  FROM (SELECT root, a, max(t) AS m FROM ev GROUP BY root, a)),
outcomes AS (
  SELECT ev.root, ev.t // 3600000000 AS hour_id,
    CASE WHEN mark IS NULL OR (ev.t // 3600000000 + 1) * 3600000000 > mark THEN 'on_time'
         WHEN mark - ev.t <= 12 * 3600000000 THEN 'corrected' ELSE 'cut_off' END AS outcome
  FROM ev JOIN steps ON ev.root = steps.root AND ev.a = steps.a)
"""

UUID_SQL = "CASE WHEN trim({0}) <> '' THEN CASE WHEN regexp_matches(regexp_replace(lower(trim({0})), '^urn:uuid:|[{{}}()-]|\\s', '', 'g'), '^[0-9a-f]{{32}}$') THEN regexp_replace(regexp_replace(lower(trim({0})), '^urn:uuid:|[{{}}()-]|\\s', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5') ELSE lower(trim({0})) END END"

P2_CTE = f"""
WITH RECURSIVE
picked AS (
  SELECT {UUID_SQL.format("execution_id")} AS node, updated_at AS seen_at,
    {UUID_SQL.format("parent_execution_id")} AS parent, {UUID_SQL.format("root_execution_id")} AS root
  FROM executions),
n AS (
  SELECT node, parent, root FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY seen_at DESC NULLS LAST, parent DESC NULLS LAST, root DESC NULLS LAST) AS k
    FROM picked WHERE node IS NOT NULL) WHERE k = 1),
up AS (SELECT n.node, n.parent FROM n WHERE parent IN (SELECT node FROM n)),
anc(node, a) AS (SELECT node, parent FROM up UNION SELECT anc.node, up.parent FROM anc JOIN up ON anc.a = up.node),
cyc AS (SELECT node FROM anc WHERE node = a),
tops AS (
  SELECT n.node, n.parent, n.root,
    (SELECT min(a) FROM anc WHERE anc.node = n.node AND a IN (SELECT node FROM cyc)) AS cycle_top,
    CASE WHEN n.node IN (SELECT node FROM up) THEN
      (SELECT min(a) FROM anc WHERE anc.node = n.node AND a NOT IN (SELECT node FROM up)) ELSE n.node END AS tree_top
  FROM n)
"""

def _opened(value: str) -> str:
    """The JSON object or list that a JSON string spells, or the value."""
    inner = f"json_extract_string({value}, '$')"
    return f"CASE WHEN json_type({value}) = 'VARCHAR' AND regexp_matches({inner}, '^\\s*[\\[{{{{]') AND json_valid({inner}) THEN {inner}::JSON ELSE {value} END".replace("{{", "{")


P5_SQL = f"""WITH RECURSIVE records AS (
  SELECT DISTINCT execution_id AS record_id, payload AS j FROM executions WHERE execution_id IS NOT NULL AND json_valid(payload)
  UNION ALL SELECT DISTINCT event_id, envelope FROM execution_events WHERE event_id IS NOT NULL AND json_valid(envelope)),
nodes(record_id, value, name, path, near, element) AS (
  SELECT record_id, {_opened("j::JSON")}, '', '', '', false FROM records
  UNION ALL
  SELECT record_id, value, name, CASE WHEN single THEN path || '[0]' ELSE path END, near, single OR (listed AND json_type(value) = 'OBJECT') FROM (
    SELECT *, NOT listed AND json_type(value) = 'OBJECT' AND name IN ({", ".join(f"'{k}'" for k in sorted(flatten.LIST_KEYS))}) AS single FROM (
      SELECT n.record_id, {_opened("c.value")} AS value, json_type(n.value) = 'ARRAY' AS listed, CASE WHEN json_type(n.value) = 'ARRAY' THEN n.name ELSE c.key END AS name,
        CASE WHEN json_type(n.value) = 'ARRAY' THEN n.path || '[' || c.key || ']' WHEN n.path = '' THEN c.key ELSE n.path || '.' || c.key END AS path,
        CASE WHEN n.element THEN n.path ELSE n.near END AS near
      FROM nodes n, json_each(n.value) c) s) t
  WHERE json_type(value) IN ('OBJECT', 'ARRAY'))
SELECT DISTINCT record_id, path AS node_path, near AS parent_path FROM nodes WHERE element"""

ORACLES = {
    "p5_found": P5_SQL,
    "p1_found": P1_CTE + "SELECT DISTINCT root AS root_execution_id, hour_id, outcome FROM outcomes WHERE outcome <> 'on_time'",
    "p1_hours": P1_CTE
    + """SELECT root AS root_execution_id, hour_id, count(*) FILTER (outcome <> 'cut_off') AS n_counted,
  count(*) FILTER (outcome = 'corrected') AS n_corrected, count(*) FILTER (outcome = 'cut_off') AS n_left_out
FROM outcomes GROUP BY 1, 2""",
    "p2_found": P2_CTE
    + """SELECT * FROM (
  SELECT t.node AS execution_id,
    CASE WHEN t.node IN (SELECT node FROM cyc) THEN 'cycle' WHEN cycle_top IS NOT NULL THEN 'into_cycle'
      WHEN top.parent IS NOT NULL AND top.node = t.node THEN 'missing_parent' WHEN top.parent IS NOT NULL THEN 'detached'
      WHEN t.root IS DISTINCT FROM tree_top THEN 'wrong_root' END AS finding,
    coalesce(cycle_top, tree_top) AS top_id
  FROM tops t LEFT JOIN n top ON top.node = t.tree_top)
WHERE finding IS NOT NULL""",
    "p2_paths": P2_CTE
    + """, walk(node, top, depth, path) AS (
  SELECT node, node, 0::BIGINT, node FROM n WHERE node NOT IN (SELECT node FROM up)
  UNION ALL SELECT up.node, walk.top, walk.depth + 1, walk.path || '/' || up.node FROM walk JOIN up ON up.parent = walk.node)
SELECT n.node AS execution_id, coalesce(walk.top, t.cycle_top) AS top_id, walk.depth AS depth, walk.path AS path,
  CASE WHEN walk.node IS NOT NULL THEN (SELECT count(*) FROM anc WHERE anc.a = n.node) END AS descendants
FROM n JOIN tops t ON t.node = n.node LEFT JOIN walk ON walk.node = n.node""",
    "p2_descendants": P2_CTE
    + """, walk(node, depth) AS (
  SELECT node, 0::BIGINT FROM n WHERE node NOT IN (SELECT node FROM up)
  UNION ALL SELECT up.node, walk.depth + 1 FROM walk JOIN up ON up.parent = walk.node)
SELECT anc.a AS execution_id, anc.node AS descendant_id, d.depth - u.depth AS distance
FROM anc JOIN walk d ON d.node = anc.node JOIN walk u ON u.node = anc.a""",
}

QUERIES = {
    "p1_found": p1_found,
    "p1_hours": p1_hours,
    "p2_found": p2_found,
    "p2_paths": p2_paths,
    "p2_descendants": p2_descendants,
    "p5_found": p5_found,
    "p5_tables": p5_tables,
}
