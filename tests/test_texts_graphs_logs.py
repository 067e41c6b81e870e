"""Text, date, vector, graph and log operators on small cases."""

from datetime import date, datetime

from pyspark.sql import functions as F

from millrace.functions import dates as D
from millrace.functions import markup as M
from millrace.functions import records as R
from millrace.functions import segments as S
from millrace.functions import text as T
from millrace.operators import eventlog, extraction, graph, vectors
from millrace.streaming import windows


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "t string").select(column("t")).collect()]


def test_text_expressions(spark):
    assert one(spark, T.word_count, "a  b\nc ", "", None) == [3, 0, -1] or one(spark, T.word_count, "a  b\nc ", "") == [3, 0]
    assert one(spark, T.without_thinking, "<think>x</think> a", "a <THINK>b", "<think>only") == ["a", "a", "<think>only"]
    assert one(spark, T.without_blobs, "x" * 2500 + " data:image/png;base64,AAAA=. y") == ["[blob] [image]. y"]
    assert one(spark, T.without_tags, "<p>a &amp; <b>b</b></p>") == ["a & b"]
    assert one(spark, T.redacted, "Bearer abc.def api_key = 55, x") == ["Bearer [REDACTED] api_key=[REDACTED], x"]
    assert one(spark, T.snake_key, " Größe (cm) ", "2 items") == ["gr_e_cm", "col_2_items"]
    assert one(spark, T.cleaned_items, "- a, 2) b\n* c,,") == [["a", "b", "c"]]
    assert one(spark, T.search_terms, "What was the archive, largest archive in the west?") == [["archive", "largest", "archive", "west"]]
    assert one(spark, T.tool_calls, 'x <tool_call>{"name": "f", "arguments": {"a": 1}}</tool_call><tool_call>{bad}</tool_call>')[0][0]["name"] == "f"
    assert one(spark, lambda c: T.kept_indices(c, 4), '{"keep": [3, 1, 1, 9]}') == [[1, 3]]
    assert one(spark, T.preview, "Head\nbody  text") == ["Head | body text"]


def test_records():
    assert R.tolerant('x ```json\n{"a": 1}\n``` y') == {"a": 1} and R.tolerant('so: {"a": "}"} ok') == {"a": "}"} and R.tolerant("none") is None
    assert R.tolerant_list('[{"a": 1}, "b", {"c": ') == [{"a": 1}, "b"] and R.tolerant_list("x") == [] and R.tolerant_list("see [1, 2] there") == [1, 2]
    assert R.content_hash('{"b": 1, "a": [2]}') == R.content_hash(' {"a":[2],"b":1}') and R.content_hash("{") is None
    assert R.call_fingerprint('{"name": "f", "arguments": {"x": 1}}') and R.call_fingerprint('{"name": "f", "arguments": 1}') is None and R.call_fingerprint('{"name": "f", "arguments": {"x": NaN}}') is None
    assert R.redacted_value({"Api-Key": 1, "reasoning": "x", "a": [{"b": "token: abc, Bearer x.y"}]}) == {"Api-Key": "[REDACTED]", "a": [{"b": "token=[REDACTED], Bearer [REDACTED]"}]}
    assert R.redacted_json("password=abc {") == "password=[REDACTED] {" and R.redacted_json(None) is None
    found = R.proposed_columns([{"name": "2 Size", "type": "odd", "description": "d"}, {"key": "2_size", "description": "again"}, {"name": "x"}])
    assert [(c["key"], c["type"]) for c in found] == [("col_2_size", "text")]


def test_unit_filters_fail_open(spark):
    rows = [(1, 0, "tiny"), (1, 1, "A sentence with enough words."), (1, 2, "a  SENTENCE with enough words."), (2, 0, "x"), (3, 0, "***** ##### $$$$$ ^^^^^ a b c d")]
    frame = spark.createDataFrame(rows, "doc_id long, pos int, unit string")
    kept = sorted((r.doc_id, r.pos) for r in T.filter_units(frame, ["basic", "unknown"]).collect())
    assert kept == [(1, 1), (2, 0), (3, 0)]
    side = spark.createDataFrame([(1, 0, "## 3. References\nx"), (1, 1, "Body"), (2, 0, "# Notes")], "doc_id long, pos int, unit string")
    assert sorted((r.doc_id, r.pos) for r in T.relevant_units(side).collect()) == [(1, 1), (2, 0)]


def test_chunks_keep_all_words():
    text = "\n\n".join(" ".join(f"w{p}_{k}" for k in range(n)) + "." for p, n in enumerate((3, 400, 20, 90, 90, 1)))
    for most in (10, 50, 150):
        parts = S.split_long(text, most)
        assert all(S.count_words(p) <= most for p in parts) and " ".join(parts).split() == text.split()
    chunks = S.overlapping_chunks(S.sections(text), 250, 150, 30)
    for before, chunk in zip(chunks, chunks[1:]):
        tail = before.split()[-30:]
        assert chunk.split()[: len(tail)] == tail
    assert S.overlapping_chunks(["short text"]) == ["short text"] and S.overlapping_chunks([]) == []
    assert S.sections("# A\nx\n## B\ny\n\nz") == ["# A\nx", "## B\ny\n\nz"]


def test_markup():
    page = "<div><h2>T</h2><p>a <b>b</b></p><ul><li>c</li><li>d</ul>tail<script>no</script></div>"
    assert M.blocks_of(page) == [("h2", "T"), ("p", "a b"), ("li", "c"), ("li", "d"), ("div", "tail")]
    assert M.markdown_of(page) == "## T\n\na b\n\n- c\n\n- d\n\ntail" and M.markdown_of("a < b") == "a < b"


def test_built_chunks_and_offsets(spark):
    page = "<h1>Head</h1><p>" + " ".join(f"w{k}" for k in range(50)) + "</p>"
    frame = spark.createDataFrame([(1, page), (2, None), (3, "x"), (4, "one two three four\n\nONE two  three four\n\nfive six seven eight")], "doc_id long, text string")
    got = {}
    for r in S.built_chunks(frame, ["basic"], 30).collect():
        got.setdefault(r.doc_id, []).append(r.chunk)
    assert set(got) == {1, 3, 4} and got[4] == ["one two three four\n\nfive six seven eight"] and got[3] == ["x"]
    assert " ".join(got[1]).split() == ["#", "Head"] + [f"w{k}" for k in range(50)]
    assert S.chunk_offsets("aa bb aa cc", ["aa", "bb", "aa", "zz"]) == [0, 3, 6, 0]


def test_append(spark):
    at = datetime(2025, 1, 1)
    log = spark.createDataFrame([("a", "r", 4, "c", "i", 2)], "event_id string, root_execution_id string, sequence long, producer_component string, producer_instance_id string, producer_sequence long")
    fresh = spark.createDataFrame([("c", "r", "c", "j", "t", at.replace(hour=2), "{}"), ("b", "r", "c", "i", "t", at, "{}"), ("a", "r", "c", "i", "t", at, "{}"), ("b", "r", "c", "i", "t", at, "{}"), ("d", "s", "c", "i", "t", None, "{}")], "event_id string, root_execution_id string, producer_component string, producer_instance_id string, event_type string, occurred_at timestamp_ntz, payload string")
    got = {r.event_id: (r.sequence, r.producer_sequence, r.caused_by_event_id) for r in eventlog.appended(log, fresh).collect()}
    assert got == {"b": (5, 3, "a"), "c": (6, 1, "b"), "d": (1, 1, None)}
    assert all(r.content_hash.startswith("sha256:") for r in eventlog.appended(log, fresh).collect())


def test_chunk_frames(spark):
    frame = spark.createDataFrame([(1, "a b", "z"), (2, None, "z"), (3, "", "z"), (1, "a b", "z")], "doc_id long, text string, pos string")
    assert sorted(tuple(r) for r in S.chunked(frame).collect()) == [(1, 1, 1, "a b"), (1, 1, 1, "a b")]


def test_date_expressions_of_every_form(spark):
    text = (
        "Seen on 2024-01-05, 31/12/2023 and 3rd of May 2024; May 7, 2024 to 9 May 2024. Last Monday? Yesterday, 2 weeks ago, within 3 days or next month, in 1999. "
        "El 12 de abril de 2023, el lunes, ayer, hace 3 días, el próximo mes. Le 4 juillet 2020, mardi, hier, il y a 2 ans. Am 5. März 2021, Freitag, gestern, vor 2 Wochen. Il 12 aprile, venerdì, ieri, tra 2 giorni. "
        "Nothing in version 2.3.1, mondays, 1234 items or 12 rows."
    )
    assert one(spark, D.expressions, text)[0] == [
        "2024-01-05", "31/12/2023", "3rd of May 2024", "May 7, 2024 to 9 May 2024", "Monday", "Yesterday", "2 weeks ago", "within 3 days", "next month", "1999",
        "12 de abril de 2023", "lunes", "ayer", "hace 3 días", "próximo mes", "4 juillet 2020", "mardi", "hier", "il y a 2 ans", "5. März 2021", "Freitag", "gestern", "vor 2 Wochen", "12 aprile", "venerdì", "ieri", "tra 2 giorni",
    ]
    assert one(spark, D.expressions, "", None) == [[], None]


def test_dates(spark):
    kinds = one(spark, D.kind_of, "3 March 2024", "2024-01-05", "last week", "ayer", "hace 3 días", "lunes", "price 5", "vor 2 Tagen", "90 minutos")
    assert kinds == ["absolute", "absolute", "relative", "relative", "relative", "absolute", None, "relative", None]
    assert one(spark, D.precision_of, "2024", "March 2024", "3 March 2024", "2024-03-05", "yesterday") == ["year", "month", "day", "day", "day"]
    anchor = date(2024, 3, 15)
    expected = {"2024-01-05": date(2024, 1, 5), "31/12/2023": date(2023, 12, 31), "4 juillet 2020": date(2020, 7, 4), "yesterday": date(2024, 3, 14), "hace 3 días": date(2024, 3, 12), "2 weeks ago": date(2024, 3, 1), "last month": date(2024, 2, 15), "December 3": date(2023, 12, 3), "monday": date(2024, 3, 11), "30 febrero 2024": None, "nothing": None}
    assert {e: D.resolve(e, anchor) for e in expected} == expected
    rows = spark.createDataFrame([("5 May 2024 to 2 May 2024", anchor), ("1999", anchor)], "e string, a date").select(*D.resolved_range("e", "a")).collect()
    assert [tuple(r) for r in rows] == [(date(2024, 5, 2), date(2024, 5, 5)), (date(1999, 1, 1), None)]
    days = {"2025-01-12": (date(2025, 1, 12), None), "2025-01-12 - 2025-02-03": (date(2025, 1, 12), date(2025, 2, 3)), "2025-01-12-2025-02-03": (date(2025, 1, 12), date(2025, 2, 3)), "3-5 May 2024": (date(2024, 5, 3), date(2024, 5, 5)), "3 to 5 mayo 2024": (date(2024, 5, 3), date(2024, 5, 5)), "monday": (date(2024, 3, 11), None), "": (None, None)}
    assert {e: D.resolve_range(e, anchor) for e in days} == days
    entries = spark.createDataFrame([(1, "May 2", date(2024, 5, 2), 10), (1, "May 2", date(2024, 5, 2), 10), (1, "2 May", date(2024, 5, 2), 12), (1, "x", None, 3), (1, "May 1", date(2024, 5, 1), 40)], "doc_id long, raw string, start date, offset int")
    assert [(r.raw, r.offset) for r in D.merged_dates(entries).collect()] == [("May 1", 40), ("May 2", 10), ("x", 3)]
    found = spark.createDataFrame([("aXbxX", "X", 2), ("aXb", "x", 0), ("a", "q", 0)], "t string, p string, c int").select(D.located("t", "p", "c")).collect()
    assert [r[0] for r in found] == [4, 1, -1]


def test_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 2.0], "a"), (3, [1.0, 1.0], "b"), (4, None, "b"), (5, [0.0, 0.0], "b"), (6, [1.0], "b")]
    points = spark.createDataFrame(rows, "id long, vector array<float>, g string")
    assert [(r.id, round(r.score, 3)) for r in vectors.search(points, [1.0, 0.0], 2).collect()] == [(1, 1.0), (3, 0.707)]
    assert [r.id for r in vectors.search(points, [1.0, 0.0], 9, 0.5, {"g": "b", "gone": 1}).collect()] == [3]
    asked = points.where("id <= 2").select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    many = {(r.query_id, r["rank"]): r.id for r in vectors.search_many(points, asked, 2).collect()}
    assert many == {(1, 1): 1, (1, 2): 3, (2, 1): 2, (2, 2): 3}
    centre = {r.g: r.centroid for r in vectors.centroids(points.where("id <= 2"), "g").collect()}
    assert [round(x, 4) for x in centre["a"]] == [0.4472, 0.8944]
    stored = spark.createDataFrame([(1, "old"), (2, "old")], "k long, v string")
    fresh = spark.createDataFrame([(2, "new"), (3, "new"), (3, "new")], "k long, v string")
    assert sorted(tuple(r) for r in vectors.upserted(stored, fresh, ["k"]).collect()) == [(1, "old"), (2, "new"), (3, "new")]
    assert vectors.upserted(vectors.upserted(stored, fresh, ["k"]), fresh, ["k"]).count() == 3
    assert vectors.deleted(stored, v="old").count() == 0 and vectors.deleted(stored, gone=1).count() == 2
    greedy = spark.createDataFrame([(1, "g", [1.0, 0.0]), (2, "g", [0.99, 0.01]), (3, "g", [0.0, 1.0]), (4, "g", None)], "id long, g string, vector array<double>")
    assert sorted(r.id for r in vectors.distinct_greedy(greedy, "g", "id").collect()) == [1, 3]


def test_graph(spark):
    entities = spark.createDataFrame([(k, f"n{k}", 1) for k in range(7)], "entity_id long, name string, project_id int")
    relations = spark.createDataFrame([(0, "to", 1, 1, 1), (1, "to", 2, 1, 1), (2, "to", 3, 1, 2), (3, "to", 0, 2, 1), (4, "to", 5, 2, 1), (1, "to", 2, 1, 1)], "src_id long, predicate string, dst_id long, resource_id int, project_id int")
    near = {(r.src_id, r.dst_id): r.dist for r in graph.neighbourhood(relations, entities, ["n0"], 2).collect()}
    assert near == {(0, 1): 0, (3, 0): 0, (1, 2): 1, (2, 3): 1}
    assert graph.neighbourhood(relations, entities, ["n0"], 1).count() == 2 and graph.neighbourhood(relations, entities, ["nowhere"], 3).count() == 0
    assert graph.delete_relation(relations, 0, "to", 1, 1).count() == 5 and graph.delete_resource(relations, 2).count() == 4
    assert graph.change_predicate(relations, 0, "to", 1, 1, "Goes To").where("predicate = 'goes_to'").count() == 1


def test_log(spark):
    at = datetime(2025, 1, 1)
    rows = [("a", "r", 1, "c", "i", 1, "operation.started", "x", "o", None, None, at), ("b", "r", 2, "c", "i", 2, "s", "x", None, None, "a", at), ("c", "r", 5, "c", "i", 2, "s", "y", None, None, "gone", at), ("b", "r", 2, "c", "i", 2, "s", "x", None, None, "a", at), ("d", "q", 1, "c", "i", 1, "s", "z", None, None, "b", at)]
    log = spark.createDataFrame(rows, "event_id string, root_execution_id string, sequence long, producer_component string, producer_instance_id string, producer_sequence long, event_type string, execution_id string, operation_id string, attempt_id string, caused_by_event_id string, ingested_at timestamp_ntz")
    assert [tuple(r) for r in eventlog.sequence_gaps(log).collect()] == [("r", 2, 5)]
    assert {tuple(r) for r in eventlog.cause_violations(log).collect()} == {("c", "unknown_cause"), ("d", "unknown_cause")}
    assert [r.event_id for r in eventlog.producer_order(log).collect()] == ["c"]
    assert eventlog.open_operations(log).count() == 1 and eventlog.deduplicated(log).count() == 4
    assert {r.execution_id: r.sequence for r in eventlog.latest_state(log).collect()} == {"x": 2, "y": 5, "z": 1}
    assert {r.root_execution_id: r.contiguous for r in eventlog.log_summary(log).collect()} == {"r": False, "q": True}


def test_extraction(spark):
    found = spark.createDataFrame([(1, 0, 0, "Blue"), (1, 1, 0, "blue"), (1, 0, 1, "Red"), (1, 0, 2, "red")], "doc_id long, chunk int, pos int, keyword string")
    assert [(r.keyword, r.n) for r in sorted(extraction.merge_keywords(found).collect(), key=lambda r: r["rank"])] == [("Blue", 2), ("Red", 1)]
    chunks = spark.createDataFrame([(1, 1, "b"), (1, 0, "a"), (2, 0, None)], "doc_id long, pos int, chunk string")
    out = extraction.map_reduce(chunks, lambda t: [x.upper() for x in t], "+".join).collect()
    assert [tuple(r) for r in out] == [(1, "A+B")]
    items = spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(1000))), (2, "x")], "id long, t string")
    assert {r.id: len(r.t.split()) for r in extraction.translated(items, list, "id", "t").collect()} == {1: 1000, 2: 1}
    turns = spark.createDataFrame([("c", k, "user" if k % 2 else "assistant", f"t{k}") for k in range(5)] + [("c", 9, "system", "s")], "conv_id string, turn int, role string, text string")
    assert sorted(r.turn for r in extraction.last_turns(turns, 3).collect()) == [2, 3, 4] and extraction.last_user_message(turns).first().text == "t3"
    steps = [("SAVE", "odd", "n" * 200, "b", "m1", ["m1"]), ("save", "fact", "x", " ", None, None), ("replace", "episode", "x", "b", "m1", ["m1"]), ("forget", "fact", "x", "b", "m9", ["m1"]), ("forget", None, None, None, "m1", ["m1"]), ("dance", None, None, None, None, None)]
    memory = spark.createDataFrame(steps, "action string, type string, name string, body string, target_id string, known_ids array<string>")
    got = [(r.action, r.type, len(r.name or ""), r.target_id) for r in extraction.memory_actions(memory).collect()]
    assert got == [("save", "fact", 120, None), ("none", None, 0, None), ("replace", "episode", 1, "m1"), ("none", None, 0, None), ("forget", None, 0, "m1"), ("none", None, 0, None)]


def test_streams(spark, tmp_path):
    at = datetime(2025, 1, 1)
    schema = "event_id string, root_execution_id string, sequence long, producer_component string, producer_instance_id string, producer_sequence long, event_type string, execution_id string, occurred_at timestamp_ntz, ingested_at timestamp_ntz"
    first = [("a", "r", 1, "c", "i", 1, "created", "x", at, at), ("b", "r", 2, "c", "i", 2, "started", "x", at.replace(hour=5), at.replace(hour=5))]
    late = [("c", "r", 3, "c", "i", 3, "late", "x", at.replace(hour=2), at.replace(hour=6)), first[0]]
    for n, rows in enumerate((first, late)):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    sink = windows.LateCounts(str(tmp_path / "out"))
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    counted = {r.hour_id - 482136: (r.n_counted, r.n_corrected) for r in sink.counts(spark).collect()}
    assert counted == {0: (1, 0), 5: (1, 0), 2: (1, 1)}
    states = windows.execution_states(stream).writeStream.format("memory").queryName("states").outputMode("update").start()
    states.processAllAvailable()
    states.stop()
    assert max((r.sequence, r.applied) for r in spark.table("states").collect())[0] == 3
    assert windows.tumbling(spark.read.schema(schema).parquet(str(tmp_path / "in/0")), "occurred_at", "1 hour", ["event_type"]).count() == 2


def test_distinct_greedy_leaves_out_what_cannot_be_used(spark):
    rows = [("g", 1, [1.0, 0.0]), ("g", 2, [2.0, 0.01]), ("g", 3, [0.0, 1.0]), ("g", 4, None), ("g", 5, [0.0, 0.0]), ("g", 6, [1.0]), ("g", 7, [float("nan"), 1.0]), ("h", 8, None), (None, 9, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "grp string, id long, vector array<double>")
    assert {(r.grp, r.id) for r in vectors.distinct_greedy(frame, "grp", "id").collect()} == {("g", 1), ("g", 3), (None, 9)}


def test_ends_progress_and_ledgers(spark):
    import json

    def event(at, kind, execution, payload):
        return (f"e{at}", kind, "r", execution, at, json.dumps({"payload": payload}) if payload is not None else None)

    entries = [{"bucket": "root", "used": 2, "reservations": [{"units": 1}, {"units": 4}]}, {"bucket": "root", "used": 3, "reservations": None}, {"bucket": "leaf", "used": None, "reservations": {"units": 7}}, {"used": 9}]
    rows = [
        event(1, "execution.state_changed", "x", {"to": "completed"}), event(2, "execution.state_changed", "x", {"to": "failed"}), event(2, "execution.state_changed", "x", {"to": "failed"}),
        event(3, "execution.state_changed", "y", {"to": "completed"}), event(4, "execution.state_changed", "y", None), event(5, "execution.state_changed", None, {"to": "failed"}),
        event(6, "progress.reported", "x", {"kind": "ledger_snapshot", "ledger": {"entries": [{"bucket": "old", "used": 1}]}}), event(7, "progress.reported", "x", {"kind": "ledger_snapshot", "ledger": {"entries": json.dumps(entries)}}),
        event(7, "progress.reported", "x", {"kind": "ledger_snapshot", "ledger": {"entries": json.dumps(entries)}}), event(8, "progress.reported", "x", {"kind": "other", "ledger": {"entries": None}}), event(9, "progress.reported", "z", {"ledger": {"entries": entries[0]}}),
    ]
    frame = spark.createDataFrame(rows, "event_id string, event_type string, root_execution_id string, execution_id string, sequence long, envelope string")
    assert [tuple(r) for r in eventlog.repeated_ends(frame).collect()] == [("r", "x", 2)]
    assert {tuple(r) for r in eventlog.progress(frame).collect()} == {("x", 3, 2), ("z", 1, 0)}
    assert {tuple(r) for r in eventlog.ledgers(frame).collect()} == {("x", "root", 5, 5), ("x", "leaf", 0, 7), ("z", "root", 2, 5)}
    assert eventlog.ledgers(frame.limit(0)).count() == 0 and eventlog.repeated_ends(frame.limit(0)).count() == 0


def test_results_above_the_budget_go_through_again(spark):
    rows = [("long", k, "ab" * 20) for k in range(6)] + [("short", 0, "xyxy"), ("none", 0, None)]
    frame = spark.createDataFrame(rows, "doc_id string, pos int, chunk string")
    halved = lambda texts: [t[: (len(t) + 1) // 2] for t in texts]
    found = dict(map(tuple, extraction.map_reduce(frame, halved, "".join, budget=20).collect()))
    # 240 characters become 120, then 60, then 30, which is within twice the budget.
    assert found == {"long": "ab" * 15, "short": "xy"}
    assert {k: len(v) for k, v in extraction.map_reduce(frame, halved, "".join, budget=20, rounds=1).collect()} == {"long": 60, "short": 2}
    assert {k: len(v) for k, v in extraction.map_reduce(frame, halved, "".join).collect()} == {"long": 120, "short": 2}
