"""Similar vectors against brute force: recall, ties, copies and unusable points."""

import numpy as np
import pytest

from millrace.llm import similar as M

SIZE = 32


def points(seed, n=900):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, SIZE))
    rows = centres[rng.integers(40, size=n)] + rng.normal(size=(n, SIZE)) * rng.choice([0.1, 0.5, 1.2], size=(n, 1))
    return (rows * rng.uniform(0.1, 9, size=(n, 1))).astype(np.float32)


def frame_of(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) if x is not None else None for x in v], "x", "y") for i, v in rows], "id string, vector array<float>, other string, rank string")


def brute(rows, k):
    good = {i: np.asarray(v, np.float64) for i, v in rows if i is not None and v is not None and len(v) == SIZE and all(x is not None for x in v) and np.isfinite(v).all() and np.any(v)}
    ids = sorted(good)
    x = np.stack([good[i] / np.linalg.norm(good[i]) for i in ids])
    cosine = x @ x.T
    np.fill_diagonal(cosine, -2)
    return {i: {ids[j] for j in np.lexsort((np.arange(len(ids)), -np.round(cosine[a], 6)))[:k]} for a, i in enumerate(ids)}, dict(zip(ids, x))


def test_recall_against_brute_force(spark):
    rows = [(f"p{k:04d}", v.tolist()) for k, v in enumerate(points(1))]
    truth, _ = brute(rows, 5)
    found = {}
    for r in M.most_similar(frame_of(spark, rows), 5, SIZE).collect():
        found.setdefault(r.id, set()).add(r.other)
    hits = sum(len(truth[i] & found.get(i, set())) for i in truth)
    assert hits / (5 * len(truth)) >= 0.9
    assert all(len(v) <= 5 for v in found.values())


def test_pairs_are_true_and_ordered(spark):
    rows = [(f"p{k:04d}", v.tolist()) for k, v in enumerate(points(2))]
    truth, unit = brute(rows, 5)
    expected = {tuple(sorted((i, j))) for i, near in truth.items() for j in near if unit[i] @ unit[j] >= 0.8}
    got = {(r.id_a, r.id_b) for r in M.similar_pairs(frame_of(spark, rows), 5, 0.8, SIZE).collect()}
    assert all(a < b for a, b in got) and len(got & expected) / len(expected) >= 0.97
    assert all(unit[a] @ unit[b] >= 0.8 - 1e-5 for a, b in got)


def test_unusable_points_and_redeliveries(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{k}", rng.normal(size=SIZE).tolist()) for k in range(30)]
    bad = [("z", [0.0] * SIZE), ("nan", [float("nan")] * SIZE), ("inf", [float("inf")] + [1.0] * (SIZE - 1)), ("short", [1.0]), ("none", None), ("hole", [None] + [1.0] * (SIZE - 1)), (None, [1.0] * SIZE), ("empty", [])]
    got = M.most_similar(frame_of(spark, rows + rows[:9] + bad), 3, SIZE).collect()
    names = {i for i, _ in rows}
    assert {r.id for r in got} == names and all(r.other in names and r.other != r.id for r in got)
    assert len(got) == 3 * len(names) == len({(r.id, r.other) for r in got})


def test_crowd_of_copies_isnt_expanded(spark, monkeypatch):
    monkeypatch.setattr(M, "MANY_COPIES", 8)
    rng = np.random.default_rng(4)
    same = rng.normal(size=SIZE).astype(np.float32).tolist()
    rows = [(f"c{k:03d}", same) for k in range(200)] + [(f"p{k}", rng.normal(size=SIZE).tolist()) for k in range(20)] + [(f"z{k}", [0.0] * SIZE) for k in range(20)]
    got = {}
    for r in M.most_similar(frame_of(spark, rows), 5, SIZE).collect():
        got.setdefault(r.id, []).append((r.rank, r.other, round(r.similarity, 4)))
    assert len(got) == 220
    assert [o for _, o, _ in sorted(got["c150"])] == ["c000", "c001", "c002", "c003", "c004"]
    assert [o for _, o, _ in sorted(got["c002"])] == ["c000", "c001", "c003", "c004", "c005"]
    assert all(s == 1.0 for _, _, s in got["c150"])


def test_many_points_are_spread_over_more_tasks(spark, monkeypatch):
    vectors = points(9, 400)
    rows = [(f"p{k}", v.tolist()) for k, v in enumerate(vectors)]
    few = sorted(map(str, M.most_similar(frame_of(spark, rows), 5, SIZE).collect()))
    monkeypatch.setattr(M, "TASK_ROWS", 20)
    assert sorted(map(str, M.most_similar(frame_of(spark, rows), 5, SIZE).collect())) == few


def test_index_of_very_many_points_stays_small():
    index = M.fit_index(M.unit(points(10, 2_000)), 1e11)
    assert index.number.dtype == np.int32 and len(index.first) <= M.MOST_CENTROIDS


def test_full_cells_are_divided(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL_ROWS", 25)
    monkeypatch.setattr(M, "LEAST_SAMPLE", 16)
    monkeypatch.setattr(M, "BLOCK_ROWS", 120)
    monkeypatch.setattr(M, "LEAST_BLOCK", 60)
    vectors = M.unit(points(5, 700))
    index = M.fit_index(vectors, len(vectors))
    assert index.inner
    visits = index.visits(vectors)
    assert all(v and len(set(v)) == len(v) for v in visits)
    own = {}
    for v in visits:
        own[v[0][1]] = own.get(v[0][1], 0) + 1
    assert max(own.values()) < 350


def test_heap_visits_in_order_of_distance():
    vectors = M.unit(points(6, 500))
    index = M.fit_index(vectors, 20_000)
    one, two = index.distances(vectors[:20])
    for at, walk in enumerate(index.walks(vectors[:20], 8)):
        sums = [one[at, i] + two[at, j] for i, j in walk]
        assert sums == sorted(sums) and len(set(walk)) == len(walk)
        assert np.isclose(sums[0], one[at].min() + two[at].min())


def test_packing_loses_nothing():
    values = np.concatenate([points(7, 20).astype(np.float16).astype(np.float32), points(8, 20), np.full((1, SIZE), 1e30, np.float32), np.full((1, SIZE), 1e-30, np.float32)])
    assert (M.unpacked(M.packed(values), SIZE) == values).all()
    assert np.allclose(np.linalg.norm(M.unit(values), axis=1), 1, atol=1e-5)


@pytest.mark.parametrize("n", [0, 1, 2])
def test_tiny_tables(spark, n):
    rows = [(f"p{k}", [1.0 + k] * SIZE) for k in range(n)]
    assert M.most_similar(frame_of(spark, rows), 5, SIZE).count() == (2 if n == 2 else 0)
