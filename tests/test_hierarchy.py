"""Hierarchies against a plain walk on random forests with cycles, hubs, chains and lost parents."""

import random
import uuid

import pytest

from millrace.operators import hierarchy as H

SCHEMA = "execution_id string, parent_execution_id string, root_execution_id string, updated_at timestamp_ntz, node string, parent int"


def spelled(rng, value):
    if value is None:
        return rng.choice([None, "", "  "])
    return rng.choice([value, value.upper(), f"{{{value}}}", f" {value}", value.replace("-", "")])


def forest(seed, n):
    rng = random.Random(seed)
    ids = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(n)]
    parent = {}
    for k, x in enumerate(ids):
        roll = rng.random()
        if k == 0 or roll < 0.08:
            parent[x] = None
        elif roll < 0.12:
            parent[x] = str(uuid.UUID(int=rng.getrandbits(128)))
        elif roll < 0.5:
            parent[x] = ids[k - 1]
        elif roll < 0.7:
            parent[x] = ids[0]
        else:
            parent[x] = ids[rng.randrange(k)]
    for size in (1, 2, 7):
        ring = [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(size)]
        for a, b in zip(ring, ring[1:] + ring[:1]):
            parent[a] = b
        tail = str(uuid.UUID(int=rng.getrandbits(128)))
        parent[tail] = ring[0]
        parent[str(uuid.UUID(int=rng.getrandbits(128)))] = tail
    return parent, rng


def walked(parent):
    out = {}
    for x in parent:
        path, at = [x], parent[x]
        while at is not None and at in parent and at not in path:
            path.append(at)
            at = parent[at]
        if at is not None and at in parent:
            out[x] = ("cycle", min(path[path.index(at) :]), None, path.index(at) == 0, None)
        else:
            out[x] = ("root" if at is None else "missing", path[-1], len(path) - 1, False, path[::-1])
    return out


@pytest.mark.parametrize("last", [4000, 60, 0])
def test_findings_and_paths_as_walked(spark, monkeypatch, last):
    monkeypatch.setattr(H, "LAST_LINKS", last)
    parent, rng = forest(5, 300)
    truth = walked(parent)
    rows = []
    for x, p in parent.items():
        top = truth[x][1]
        root = top if rng.random() < 0.7 else rng.choice([None, p, str(uuid.uuid4())])
        row = (x, spelled(rng, p), spelled(rng, root), None, "n", 1)
        rows.append(row)
        if rng.random() < 0.1:
            rows.append(row)
    frame = spark.createDataFrame(rows, SCHEMA)
    claimed = {x: (r or "").strip().strip("{}").lower() for x, _, r, *_ in rows}
    expected = set()
    for x, (kind, top, _, on, _) in truth.items():
        if kind == "cycle":
            expected.add((x, "cycle" if on else "into_cycle", top))
        elif kind == "missing":
            expected.add((x, "missing_parent" if top == x else "detached", top))
        elif claimed[x].replace("-", "") != top.replace("-", ""):
            expected.add((x, "wrong_root", top))
    assert {tuple(r) for r in H.hierarchy_findings(frame).collect()} == expected

    sizes = {}
    for _, _, _, _, path in truth.values():
        for y in path or []:
            sizes[y] = sizes.get(y, 0) + 1
    for r in H.hierarchy_paths(frame).collect():
        kind, top, depth, _, path = truth[r.execution_id]
        assert (r.top_id, r.depth) == (top, depth)
        assert r.path == ("/".join(path) if path else None)
        assert r.descendants == (sizes[r.execution_id] - 1 if path else None)
    links = {tuple(r) for r in H.descendant_links(frame).collect()}
    assert links == {(y, x, len(path) - 1 - k) for x, (_, _, _, _, path) in truth.items() for k, y in enumerate(path or []) if y != x}


def test_long_chain_and_wide_hub(spark):
    chain = [(f"c{k:04d}", f"c{k - 1:04d}" if k else None, "c0000", None, None, None) for k in range(700)]
    hub = [(f"h{k}", "h0" if k else None, "h0", None, None, None) for k in range(500)]
    got = {r.execution_id: (r.top_id, r.depth, r.descendants) for r in H.hierarchy_paths(spark.createDataFrame(chain + hub, SCHEMA)).collect()}
    assert got["c0699"] == ("c0000", 699, 0) and got["c0000"] == ("c0000", 0, 699) and got["h0"] == ("h0", 0, 499) and got["h7"] == ("h0", 1, 0)


def test_nulls_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.hierarchy_findings(empty).count() == 0 and H.hierarchy_paths(empty).count() == 0
    rows = [(None, None, None, None, None, None), ("", "a", None, None, None, None), ("a", None, None, None, None, None), ("b", "b", None, None, None, None)]
    assert {tuple(r) for r in H.hierarchy_findings(spark.createDataFrame(rows, SCHEMA)).collect()} == {("a", "wrong_root", "a"), ("b", "cycle", "b")}


def test_newest_delivery_counts(spark):
    from datetime import datetime

    rows = [("a", None, "a", None, None, None), ("b", "gone", "a", datetime(2025, 1, 1), None, None), ("b", "a", "a", datetime(2025, 1, 2), None, None)]
    assert H.hierarchy_findings(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_leaves_and_cycles_stay_out_of_the_last_task(spark, monkeypatch):
    monkeypatch.setattr(H, "LAST_LINKS", 40)
    entered, last_rounds = [], H._last_rounds
    monkeypatch.setattr(H, "_last_rounds", lambda live, *rest: (entered.append(live.count()), last_rounds(live, *rest))[1])
    chain = [(f"c{k:04d}", f"c{k - 1:04d}" if k else None, "c0000", None, None, None) for k in range(30)]
    hub = [(f"h{k:04d}", "c0010", "c0000", None, None, None) for k in range(500)]
    loops = [(f"s{k:03d}", f"s{k:03d}", "x", None, None, None) for k in range(150)]
    below = [(f"t{k}", f"s{k:03d}", "x", None, None, None) for k in range(3)]
    rows = spark.createDataFrame(chain + hub + loops + below, SCHEMA)
    got = {r.execution_id: (r.top_id, r.depth, r.descendants) for r in H.hierarchy_paths(rows).collect()}
    assert len(entered) == 1 and entered[0] <= 80
    assert len(got) == 30 + 500 + 150 + 3
    assert all(got[f"c{k:04d}"] == ("c0000", k, 29 - k + (500 if k <= 10 else 0)) for k in range(30))
    assert got["h0007"] == ("c0000", 11, 0) and got["s149"] == ("s149", None, None) and got["t2"] == ("s002", None, None)
    findings = [r.finding for r in H.hierarchy_findings(rows).collect()]
    assert findings.count("cycle") == 150 and findings.count("into_cycle") == 3
