"""Queries of the text, record and answer functions, each beside its SQL where SQL can state it.

Inputs are whole tables; where a function works on answers of a model, texts of the documents stand for them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates, markup, records, scalars, segments, text
from millrace.operators import eventlog, extraction, graph, vectors
from millrace.plans.registry import Query, registrar
from millrace.session import spread
from millrace.sources import readers

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
query = registrar(QUERIES, ORACLES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{folder}/{name}.parquet")
    # Work on texts is heavy for its bytes: a table of few splits is spread over all tasks.
    return spread(rows) if name == "documents" else rows


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null")


_TOKENS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda x: x <> '')"
_SENTENCES = "list_filter(list_transform(string_split(regexp_replace({0}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, ' ')), lambda x: x <> '')"


def _collapsed(expression: str) -> str:
    return f"trim(regexp_replace({expression}, '\\s+', ' ', 'g'), ' ')"


# --- texts

_BARE = "regexp_replace(text, '<[^>]+>', ' ', 'g')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _BARE = f"replace({_BARE}, '{_entity}', '{_char}')"


@query(f"SELECT doc_id, {_collapsed(_BARE)} AS text FROM documents WHERE text IS NOT NULL")
def text_without_tags(spark, folder):
    return _texts(spark, folder).select("doc_id", text.without_tags("text").alias("text"))


_CLOSED = "regexp_replace(text, '<think>.*?</think>', '', 'gis')"
_HEAD = f"trim(regexp_extract({_CLOSED}, '(?is)^(.*?)<think>', 1), ' ')"


@query(f"SELECT doc_id, trim(CASE WHEN regexp_matches({_CLOSED}, '<think>', 'i') AND {_HEAD} <> '' THEN {_HEAD} ELSE {_CLOSED} END, ' ') AS text FROM documents WHERE text IS NOT NULL")
def text_without_thinking(spark, folder):
    return _texts(spark, folder).select("doc_id", text.without_thinking("text").alias("text"))


@query("SELECT doc_id, left(text, 2048) AS text, length(text) > 2048 AS truncated FROM documents WHERE text IS NOT NULL")
def text_budget(spark, folder):
    """What fits a model of 1 536 tokens that answers with 512."""
    most = text.char_budget(1536, 512)
    return _texts(spark, folder).select("doc_id", text.first_chars("text", most).alias("text"), (F.length("text") > most).alias("truncated"))


@query(f"SELECT doc_id, array_to_string({_TOKENS.format('text')}[1:12], ' ') AS words FROM documents WHERE text IS NOT NULL")
def text_first_words(spark, folder):
    return _texts(spark, folder).select("doc_id", text.first_words("text", 12).alias("words"))


@query(
    """SELECT doc_id, pos::INT AS pos, item FROM (SELECT doc_id, unnest(items) AS item, generate_subscripts(items, 1) - 1 AS pos FROM (
SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[\\n,]+'), lambda x: trim(regexp_replace(x, '^\\s*(?:[-*•]|\\d+[.)])\\s*', ''), ' ')), lambda x: x <> '') AS items FROM documents WHERE text IS NOT NULL))"""
)
def text_items(spark, folder):
    """Items of an answer that is a list."""
    return _texts(spark, folder).select("doc_id", F.posexplode(text.cleaned_items("text")).alias("pos", "item"))


@query(
    f"""SELECT doc_id, trim(regexp_replace(sentence, '^\\s*(?:\\d+[.)]|[-*•])\\s*', ''), ' ') AS sentence, count(*) AS n FROM (
SELECT doc_id, unnest({_SENTENCES.format("text")}) AS sentence FROM documents WHERE text IS NOT NULL) GROUP BY 1, 2"""
)
def text_sentences(spark, folder):
    rows = _texts(spark, folder).select("doc_id", F.explode(text.sentences("text")).alias("sentence"))
    return rows.groupBy("doc_id", text.cleaned_sentence("sentence").alias("sentence")).agg(F.count(F.lit(1)).alias("n"))


_REDACTED = """regexp_replace(regexp_replace(regexp_replace(text, '<think>.*?</think>', '', 'gsi'), '\\bbearer\\s+[A-Za-z0-9._~+/-]+=*', 'Bearer [REDACTED]', 'gi'),
'\\b(access[_-]?token|api[_-]?key|auth[_-]?token|authorization|cookie|id[_-]?token|password|refresh[_-]?token|session[_-]?token|token)\\s*[:=]\\s*([^\\s,;]+)', '\\1=[REDACTED]', 'gi')"""


@query(f"SELECT doc_id, left({_collapsed(_REDACTED)}, 200) AS summary FROM documents WHERE text IS NOT NULL")
def text_summary_line(spark, folder):
    return _texts(spark, folder).select("doc_id", text.result_summary("text").alias("summary"))


@query(
    """SELECT doc_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '\\d+'), lambda x: TRY_CAST(x AS INTEGER)), lambda x: x IS NOT NULL AND x < 50))) AS kept
FROM documents WHERE text IS NOT NULL"""
)
def text_kept_indices(spark, folder):
    return _texts(spark, folder).select("doc_id", text.kept_indices("text", 50).alias("kept"))


@query(
    """SELECT doc_id, CASE WHEN length(trim(text, ' ')) > 300 THEN left(trim(text, ' '), 300) || '…' ELSE trim(text, ' ') END AS snippet, CASE WHEN length(trim(doc_kind, ' ')) < 8 OR n_chars IS NULL THEN 'recent'
WHEN n_chars / 1000.0 > 0.85 THEN 'high' ELSE 'medium' END AS relevance FROM documents WHERE text IS NOT NULL AND doc_kind IS NOT NULL"""
)
def hits_shown(spark, folder):
    """Snippets and labels of hits; the length of a text stands for a score, its kind for the question."""
    hits = _texts(spark, folder).where("doc_kind is not null").withColumn("score", F.col("n_chars") / 1000)
    return vectors.snippets(hits).select("doc_id", "snippet", vectors.relevance("score", "doc_kind").alias("relevance"))


@query(
    """SELECT string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM (SELECT text, row_number() OVER (ORDER BY created_at DESC NULLS LAST, doc_id DESC) AS rank
FROM documents WHERE source = 'inbox_sync' AND text IS NOT NULL) WHERE rank <= 5"""
)
def hits_context(spark, folder):
    """The newest five documents of a source as the context of an answer."""
    newest = vectors.recent(_texts(spark, folder), "source", "inbox_sync", key="doc_id", most=5)
    return vectors.context_text(newest.withColumn("rank", F.struct(-F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(-(1 << 62))), -F.col("doc_id"))))


@query("SELECT DISTINCT '- ' || c_mktsegment || ' --[deals_with]--> ' || n_name AS line FROM customer JOIN nation ON c_nationkey = n_nationkey")
def graph_lines(spark, folder):
    joined = table(spark, folder, "customer").join(table(spark, folder, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    edges = joined.select(F.col("c_mktsegment").alias("subject"), F.lit("deals_with").alias("predicate"), F.col("n_name").alias("object")).distinct()
    return vectors.graph_lines(edges)


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\\S'))) > 0 AS filled FROM documents WHERE text IS NOT NULL")
def text_filled(spark, folder):
    return readers.text_pages(_texts(spark, folder)).select("doc_id", (F.length(F.regexp_replace("content", r"</?p>|\s", "")) > 0).alias("filled"))


@query()
def text_chunk_offsets(spark, folder):
    """Where each packed chunk starts in its text."""

    @F.pandas_udf("array<int>")
    def offsets(texts: pd.Series, chunks: pd.Series) -> pd.Series:
        return pd.Series([segments.chunk_offsets(t, list(c)) for t, c in zip(texts, chunks, strict=True)])

    chunks = segments.exploded(_texts(spark, folder), segments.greedy_chunks)
    lists = chunks.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]).alias("chunks"))
    joined = _texts(spark, folder).select("doc_id", "text").join(lists, "doc_id")
    return joined.select("doc_id", F.posexplode(offsets("text", "chunks")).alias("pos", "offset"))


@query(
    """SELECT doc_id, instr(text, needle) - 1 AS offset, trim(substring(text, greatest(instr(text, needle) - 1 - 60, 0) + 1, instr(text, needle) - 1 - greatest(instr(text, needle) - 1 - 60, 0) + length(needle) + 60), ' ') AS context
FROM (SELECT doc_id, text, regexp_extract(text, '\\d{4}-\\d{2}-\\d{2}') AS needle FROM documents WHERE text IS NOT NULL) WHERE needle <> ''"""
)
def date_context(spark, folder):
    """What stands around the first day in numbers of each text."""
    rows = _texts(spark, folder).select("doc_id", "text", F.regexp_extract("text", r"\d{4}-\d{2}-\d{2}", 0).alias("needle")).where("needle <> ''").withColumn("offset", dates.located("text", "needle"))
    return rows.select("doc_id", "offset", dates.snippet("text", "offset", F.length("needle")).alias("context"))


# --- answers


_WORDS = "(SELECT doc_id, chunk, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS word FROM (SELECT doc_id, chunk, regexp_extract_all(line, '\\p{L}{5,}') AS l FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS chunk FROM documents WHERE text IS NOT NULL)))"


def _words(spark: SparkSession, folder: str) -> DataFrame:
    lines = _texts(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("chunk", "line"))
    return lines.select("doc_id", "chunk", F.posexplode(F.regexp_extract_all("line", F.lit(r"\p{L}{5,}"), F.lit(0))).alias("pos", "word"))


@query(
    f"""WITH w AS {_WORDS}, g AS (SELECT doc_id, lower(word) AS k, count(DISTINCT chunk) AS n, min(struct_pack(chunk := chunk, pos := pos, word := word)) AS first FROM w GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM g) SELECT doc_id, rank::INT AS rank, first.word AS keyword, n FROM r WHERE rank <= 10"""
)
def keywords_merged(spark, folder):
    """Keywords of chunks merged to those of their documents; words of five letters and more stand for a model's."""
    return extraction.merge_keywords(_words(spark, folder).withColumnRenamed("word", "keyword"))


_LABEL = "CASE WHEN length(word) % 4 = 0 THEN 'ORG' WHEN length(word) % 4 = 1 THEN 'language' WHEN length(word) % 4 = 2 THEN ' person ' ELSE 'NUMBER' END"


@query(
    f"""WITH w AS {_WORDS}, e AS (SELECT doc_id, chunk * 1000000 + pos AS pos, word, {_LABEL} AS label FROM w),
v AS (SELECT * FROM e WHERE upper(trim(label, ' ')) IN ('ORG', 'LANGUAGE', 'PERSON') AND (upper(label) = 'LANGUAGE' OR regexp_matches(word, '\\p{{Lu}}')))
SELECT doc_id, e.pos AS pos, e.word AS word, e.label AS label FROM (SELECT doc_id, min(struct_pack(pos := pos, word := word, label := label)) AS e FROM v GROUP BY doc_id, lower(word))"""
)
def entities_merged(spark, folder):
    """Entities of a document, the first of each; the length of a word stands for a model's label."""
    found = _words(spark, folder).select("doc_id", (F.col("chunk").cast("long") * 1000000 + F.col("pos")).alias("pos"), "word", F.expr(_LABEL).alias("label"))
    return extraction.merge_entities(found)


@query(f"SELECT doc_id, replace(array_to_string({_TOKENS.format('text')}, ' '), 'e', 'é') AS text FROM documents WHERE regexp_matches(text, '\\S')")
def answers_translated(spark, folder):
    """Texts cut, answered in batches and joined again; an accent stands for a translation."""
    return extraction.translated(_texts(spark, folder).where(r"text rlike '\\S'").select("doc_id", "text"), lambda texts: [t.replace("e", "é") for t in texts], "doc_id", "text", 40)


@query("SELECT doc_id, array_to_string(list_transform(string_split(text, chr(10)), lambda x: length(x)::VARCHAR), '+') AS result FROM documents WHERE text IS NOT NULL")
def answers_reduced(spark, folder):
    """Answers for the parts of a text, merged in order; the length of a line stands for an answer."""
    parts = _texts(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "chunk"))
    return extraction.map_reduce(parts, lambda texts: [str(len(t)) for t in texts], "+".join)


@query(
    """WITH p AS (SELECT doc_id, lower(trim(doc_kind, ' ')) AS action, lang AS type, source AS name, text AS body, doc_id % 7 AS target FROM documents),
d AS (SELECT *, CASE WHEN doc_id % 3 = 0 AND trim(coalesce(name, ''), ' ') <> '' AND trim(coalesce(body, ''), ' ') <> '' THEN 'save'
WHEN doc_id % 3 = 1 AND trim(coalesce(name, ''), ' ') <> '' AND trim(coalesce(body, ''), ' ') <> '' AND target IN (1, 2, 3) THEN 'replace' WHEN doc_id % 3 = 2 AND target IN (1, 2, 3) THEN 'forget' ELSE 'none' END AS done FROM p)
SELECT done AS action, CASE WHEN done IN ('save', 'replace') THEN CASE WHEN lower(trim(type, ' ')) IN ('fact', 'episode', 'instruction') THEN lower(trim(type, ' ')) ELSE 'fact' END END AS type,
CASE WHEN done IN ('save', 'replace') THEN left(trim(name, ' '), 120) END AS name, CASE WHEN done IN ('save', 'replace') THEN trim(body, ' ') END AS body, CASE WHEN done IN ('replace', 'forget') THEN target END AS target_id FROM d"""
)
def memory_actions(spark, folder):
    """Memory steps that a model might propose, checked against the ids it was shown."""
    action = F.element_at(F.array(F.lit("Save"), F.lit("replace "), F.lit("FORGET")), (F.col("doc_id") % 3 + 1).cast("int"))
    proposed = table(spark, folder, "documents").select(action.alias("action"), F.col("lang").alias("type"), F.col("source").alias("name"), F.col("text").alias("body"), (F.col("doc_id") % 7).alias("target_id"), F.array(*(F.lit(k).cast("long") for k in (1, 2, 3))).alias("known_ids"))
    return extraction.memory_actions(proposed)


@query(
    """SELECT execution_id, pos::INT AS pos, call.name AS name, call.arguments AS arguments FROM (SELECT execution_id, unnest(calls) AS call, generate_subscripts(calls, 1) - 1 AS pos FROM (
SELECT DISTINCT execution_id, [struct_pack(name := task_type, arguments := '{"n":1}'), struct_pack(name := 'second', arguments := NULL)] AS calls FROM executions WHERE task_type IS NOT NULL)) s"""
)
def tool_calls(spark, folder):
    """Calls written into an answer; the second has no arguments, the third can't be read, the fourth has no name."""
    answer = F.concat(F.lit('<tool_call>{"name": "'), "task_type", F.lit('", "arguments": {"n": 1}}</tool_call> and <tool_call> {"name": "second"} </tool_call><tool_call>{"name</tool_call><tool_call>{"name": ""}</tool_call>'))
    rows = table(spark, folder, "executions").where("task_type is not null").select("execution_id", answer.alias("answer")).distinct()
    return rows.select("execution_id", F.posexplode(text.tool_calls("answer")).alias("pos", "call")).select("execution_id", "pos", "call.name", "call.arguments")


@query("SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_type, ' ')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS key, replace(lower(trim(p_name, ' ')), ' ', '_') AS predicate FROM part")
def names_to_keys(spark, folder):
    return table(spark, folder, "part").select("p_partkey", text.snake_key("p_type").alias("key"), text.predicate_name("p_name").alias("predicate"))


@query(
    """SELECT c_custkey, CASE WHEN NOT regexp_matches(v, '^\\s*[+-]?0[0-9]+') THEN CASE WHEN regexp_matches(v, '^\\s*[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?\\s*$') THEN v::DOUBLE END END AS cell
FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_acctbal::VARCHAR WHEN 1 THEN '00' || c_custkey WHEN 2 THEN c_name ELSE c_custkey::VARCHAR END AS v FROM customer)"""
)
def spreadsheet_cells(spark, folder):
    """Cells of a written sheet: numbers become numbers unless they start with a zero."""
    kinds = F.when(F.col("c_custkey") % 4 == 0, F.col("c_acctbal").cast("string")).when(F.col("c_custkey") % 4 == 1, F.concat(F.lit("00"), "c_custkey"))
    kinds = kinds.when(F.col("c_custkey") % 4 == 2, F.col("c_name")).otherwise(F.col("c_custkey").cast("string"))
    return table(spark, folder, "customer").select("c_custkey", kinds.alias("v")).select("c_custkey", readers.spreadsheet_cell("v").alias("cell"))


# --- records


@query()
def record_fingerprints(spark, folder):
    """Hash of each operation's name and arguments, whatever the order and spelling of its keys."""
    rows = table(spark, folder, "execution_events").where("event_type = 'operation.started' and envelope is not null").select("event_id", F.get_json_object("envelope", "$.payload").alias("p"))
    call = F.to_json(F.struct(F.get_json_object("p", "$.name").alias("name"), F.from_json("p", "map<string,string>").alias("arguments")))
    return rows.distinct().select("event_id", records.to_fingerprint(call).alias("fingerprint"))


@query()
def record_lists(spark, folder):
    """Lists that stand in an answer, with some text around them, item by item."""
    rows = table(spark, folder, "executions").where("task_type = 'assistant_chat' and payload is not null").select("execution_id", "payload").distinct()
    answer = F.concat(F.lit("Here it is:\n```json\n"), F.get_json_object("payload", "$.messages"), F.lit("\n```"))
    return rows.select("execution_id", F.size(records.to_list(answer)).alias("n")).where("n > 0").distinct()


@query()
def columns_proposed(spark, folder):
    """Columns proposed for a dataset, checked: the columns that extractions were asked for stand for a model's proposal."""

    @F.pandas_udf("array<string>")
    def checked(lists: pd.Series) -> pd.Series:
        proposed = lists.map(lambda t: [c | {"description": c.get("description") or c.get("name") or c.get("key")} for c in records.tolerant_list(t) if isinstance(c, dict)])
        return proposed.map(lambda columns: [records.canonical(c) for c in records.proposed_columns(columns)])

    asked = table(spark, folder, "executions").where("payload is not null").select("execution_id", F.get_json_object("payload", "$.columns").alias("columns")).where("columns is not null").distinct()
    return asked.select("execution_id", F.posexplode(checked("columns")).alias("pos", "column"))


@query()
def page_fields(spark, folder):
    """Title, author, date and content of the texts that are pages."""

    @F.pandas_udf("title string, author string, date string, content string")
    def fields(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([markup.page_fields(p) for p in pages], columns=["title", "author", "date", "content"])

    pages = _texts(spark, folder).where("text rlike '<[a-zA-Z/!?]'")
    return pages.select("doc_id", fields("text").alias("f")).select("doc_id", "f.*")


@query()
def files_parsed(spark, folder):
    """Texts as files of the kinds that can be parsed, by kind, and of one that can't."""
    kind = F.element_at(F.array(*map(F.lit, ("html", "txt", "md", "eml", "pdf"))), (F.col("doc_id") % 5 + 1).cast("int"))
    mail = F.concat(F.lit("Subject: "), F.col("source"), F.lit("\nFrom: a@b.example\nContent-Type: text/plain; charset=utf-8\n\n"), "text")
    body = F.when(kind == "eml", F.coalesce(mail, F.col("text"))).otherwise(F.col("text"))
    return readers.parse_files(_texts(spark, folder).select(F.concat_ws(".", F.col("doc_id").cast("string"), kind).alias("path"), F.encode(body, "UTF-8").alias("content")))


@query("SELECT event_id AS _id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, json_extract_string(props, '$.k') AS t FROM events")
def dataset_loaded(spark, folder):
    schema = readers.DatasetSchema((readers.Field("k", "number"), readers.Field("t", "text")))
    stored = table(spark, folder, "events").select(F.col("event_id").alias("id"), F.concat(F.lit('{"k": '), F.get_json_object("props", "$.k"), F.lit(', "t": "'), F.get_json_object("props", "$.k"), F.lit('"}')).alias("data"))
    return readers.typed_records(stored, schema)


# --- relations and logs


@query(
    """WITH r AS (SELECT 'n' || n_nationkey AS src_id, 'in_region' AS predicate, 'r' || n_regionkey AS dst_id, 1 AS resource_id, n_regionkey / 10.0 AS confidence FROM nation)
SELECT src_id, predicate, dst_id, resource_id, round(CASE WHEN dst_id = 'r1' THEN 0.9 ELSE confidence END, 3)::DOUBLE AS confidence FROM r WHERE src_id <> 'n3'"""
)
def graph_relations_kept(spark, folder):
    """Relations of one subject, predicate, object and resource are one; the fresh one stands, and one is deleted."""
    nation = table(spark, folder, "nation")
    stored = nation.select(
        F.concat(F.lit("n"), "n_nationkey").alias("src_id"), F.lit("in_region").alias("predicate"), F.concat(F.lit("r"), "n_regionkey").alias("dst_id"), F.lit(1).alias("resource_id"), (F.col("n_regionkey") / 10).alias("confidence")
    )
    fresh = stored.where("dst_id = 'r1'").withColumn("confidence", F.lit(0.9))
    target = nation.where("n_nationkey = 3").select(F.concat(F.lit("r"), "n_regionkey")).first()[0]
    kept = graph.delete_relation(graph.upsert_relations(stored, fresh), "n3", "in_region", target, 1)
    return kept.withColumn("confidence", F.round("confidence", 3))


@query(
    """WITH e AS (SELECT event_id, any_value(root_execution_id) AS root, any_value(execution_id) AS execution, any_value(json_extract_string(envelope, '$.payload.to')) AS state FROM execution_events
WHERE event_id IS NOT NULL AND event_type = 'execution.state_changed' AND json_valid(envelope) GROUP BY 1)
SELECT root AS root_execution_id, execution AS execution_id, count(*) AS n_ends FROM e WHERE state IN ('completed', 'failed', 'cancelled') AND execution IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1"""
)
def log_repeated_ends(spark, folder):
    """Executions that came to an end more than once."""
    return eventlog.repeated_ends(table(spark, folder, "execution_events"))


@query(
    """SELECT execution_id, count(*) AS n_reports, count(*) FILTER (kind = 'ledger_snapshot') AS n_ledgers FROM (SELECT event_id, any_value(execution_id) AS execution_id,
any_value(CASE WHEN json_valid(envelope) THEN json_extract_string(envelope, '$.payload.kind') END) AS kind FROM execution_events WHERE event_id IS NOT NULL AND event_type = 'progress.reported' AND envelope IS NOT NULL GROUP BY 1)
WHERE execution_id IS NOT NULL GROUP BY 1"""
)
def log_progress(spark, folder):
    """Progress reports of each execution, replayed from the log."""
    return eventlog.progress(table(spark, folder, "execution_events"))


@query()
def log_ledgers(spark, folder):
    """What each execution has used and reserved as of its last ledger."""
    return eventlog.ledgers(table(spark, folder, "execution_events"))
