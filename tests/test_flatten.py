"""Flat tables of nested records against a plain recursion, and the rules of inlining."""

import json

from hypothesis import given
from hypothesis import strategies as st

from millrace.operators import flatten as X


def plain(record, keys=X.LIST_KEYS):
    out = set()

    def load(v):
        while isinstance(v, str):
            try:
                w = json.loads(v)
            except ValueError:
                return v
            if not isinstance(w, (dict, list)):
                return v
            v = w
        return v

    def walk(v, key, path, near, in_list):
        v = load(v)
        if isinstance(v, dict):
            if not in_list and key in keys:
                path, in_list = path + "[0]", True
            if in_list:
                out.add((path, near))
                near = path
            for k, c in v.items():
                walk(c, k, f"{path}.{k}" if path else k, near, False)
        elif isinstance(v, list):
            for at, c in enumerate(v):
                walk(c, key, f"{path}[{at}]", near, True)

    walk(record, "$", "", "", False)
    return out


RECORDS = [
    {"messages": [{"role": "user", "attachments": [{"fileId": 1, "spans": {"start": 1}}, None, {"spans": [{"start": 2}, {"start": 3}]}]}, None, {"role": "tool"}]},
    {"params": {"filters": '[{"any": "[{\\"field\\": 1}, {\\"field\\": 2}]"}, {"all": {"field": 3}}]', "sort": None, "value": "[8]"}},
    {"context": {"project": {"notes": {"text": "pinned"}}}, "units": [], "notes": {}},
    [{"a": [[{"b": 1}], [2]]}, "text", 5],
    {"deep": {"deep": {"deep": {"x": [{"deep": {"y": 1}}]}}}},
    "[{\"entries\": {\"n\": 1}}]",
    {"text": '{"cut off', "quoted": '"[1]"'},
]


def frame_of(spark):
    rows = [(f"r{k}", json.dumps(r)) for k, r in enumerate(RECORDS)]
    rows += [("r0", json.dumps(RECORDS[0])), ("bad", '{"messages": [{'), ("none", None), (None, json.dumps(RECORDS[0])), ("empty", "")]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], "id string, body string, record_id string, node_path string")


def test_list_elements_as_recursion(spark):
    found = {tuple(r) for r in X.list_elements(frame_of(spark), "id", "body").collect()}
    assert found == {(f"r{k}", *row) for k, r in enumerate(RECORDS) for row in plain(r)}
    assert X.list_elements(frame_of(spark), "id", "body").count() == len(found)


def test_relations_follow_the_graph():
    edges = [("$", "$", False), ("$", "a", False), ("a", "b", True), ("a", "c", False), ("$", "c", False), ("$", "d", False), ("d", "d2", False), ("d2", "d", False)]
    reason = X.relations(edges)
    assert reason == {"$": "root", "b": "repeated", "c": "shared", "d": "shared", "d2": "recursive"}


def test_rows_keep_links_and_inlined_columns(spark):
    rows = {r.node_path: r for r in X.flat_tables(frame_of(spark).where("id = 'r0'"), "id", "body").collect()}
    inner = rows["messages[0].attachments[0].spans[0]"]
    assert (inner.table_name, inner.owner_path, inner.parent_path) == ("spans", "messages[0].attachments[0]", "messages[0].attachments[0]")
    assert json.loads(rows["messages[0]"].columns) == {"role": "user"}
    assert rows[""].table_name == "$" and rows[""].owner_path is None and rows["messages[0]"].owner_path == ""
    assert all(r.owner_path is None or r.owner_path in rows for r in rows.values())


def test_round_trip_of_scalars(spark):
    record = {"id": 5, "meta": {"lang": "en", "tags": ["a", "b"]}, "units": [{"pos": 0, "text": "x"}, {"pos": 1, "text": None}]}
    frame = spark.createDataFrame([("a", json.dumps(record))], "id string, body string")
    rows = {r.node_path: json.loads(r.columns) for r in X.flat_tables(frame, "id", "body").collect()}
    assert rows == {"": {"id": "5", "meta.lang": "en", "meta.tags": '["a", "b"]'}, "units[0]": {"pos": "0", "text": "x"}, "units[1]": {"pos": "1", "text": None}}


def test_empty_and_very_deep(spark):
    schema = "id string, body string"
    assert X.list_elements(spark.createDataFrame([], schema), "id", "body").count() == 0
    deep = '{"hits": [' * 300 + "{}" + "]}" * 300
    assert X.list_elements(spark.createDataFrame([("d", deep)], schema), "id", "body").count() == 301 - 1


def test_deeper_than_the_interpreter(spark):
    depth = 6_000
    deep = '{"hits": [' * depth + '{"a": "b"}' + "]}" * depth
    rows = [("d", deep), ("l", "[" * 20_000 + "{}" + "]" * 20_000), ("cut", deep[:-1]), ("wrong", '{"hits": [' * depth + "}]" + "]}" * depth)]
    found = X.list_elements(spark.createDataFrame(rows, "id string, body string"), "id", "body").groupBy("record_id").count().collect()
    assert {tuple(r) for r in found} == {("d", depth), ("l", 1)}


@given(st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(), x, max_size=4), max_leaves=12), st.booleans(), st.integers(0, 200))
def test_deep_reader_agrees_with_the_usual_one(value, wide, cut):
    text = json.dumps(value, indent=1 if wide else None)
    assert X._read_deep(text) == value
    broken = text[:cut] + text[cut + 1 :]
    try:
        expected = json.loads(broken)
    except ValueError:
        expected = None
    assert X._read_deep(broken) == expected


def test_graph_too_large_for_the_driver(spark):
    rows = [("a", json.dumps({f"k{n}": {"units": [{"x": n}, 3, {}]} for n in range(20)}))]
    frame = spark.createDataFrame(rows, "id string, body string")
    whole = sorted(map(str, X.list_elements(frame, "id", "body").collect()))
    assert len(whole) == 40 and sorted(map(str, X.list_elements(frame, "id", "body", most=10).collect())) == whole


def test_tables_of_payloads_and_envelopes(spark, tmp_path):
    from millrace.plans.problem_queries import p5_tables

    record = json.dumps({"n": 1, "units": [{"pos": 0}]})
    spark.createDataFrame([("x", record)], "execution_id string, payload string").write.parquet(f"{tmp_path}/executions.parquet")
    spark.createDataFrame([("x", record), ("y", '{"spans": [{"a": 2}]}')], "event_id string, envelope string").write.parquet(f"{tmp_path}/execution_events.parquet")
    rows = {(r.source, r.table_name, r.record_id, r.owner_path, r.columns) for r in p5_tables(spark, str(tmp_path)).collect()}
    assert rows == {
        ("executions.payload", "$", "x", None, '{"n": "1"}'),
        ("executions.payload", "units", "x", "", '{"pos": "0"}'),
        ("execution_events.envelope", "$", "x", None, '{"n": "1"}'),
        ("execution_events.envelope", "units", "x", "", '{"pos": "0"}'),
        ("execution_events.envelope", "$", "y", None, "{}"),
        ("execution_events.envelope", "spans", "y", "", '{"a": "2"}'),
    }
