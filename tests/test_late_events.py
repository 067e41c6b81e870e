"""Late events against a plain replay, and the laws of the counters."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.operators import late_events as L

SCHEMA = "event_id string, root_execution_id string, sequence long, producer_component string, producer_instance_id string, producer_sequence long, occurred_at timestamp_ntz, ingested_at timestamp_ntz, note string, hour_id int"
START = datetime(2025, 3, 29, 12)


def rows_of(seed, n=400, hot=0.4):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        root = "hot" if rng.random() < hot else f"r{rng.randrange(12)}"
        occurred = START + timedelta(minutes=rng.randrange(3000))
        ingested = occurred + timedelta(minutes=rng.choice([0, 0, 1, 5, 90, 400, 2000]), seconds=rng.choice([0, 0, 30]))
        if rng.random() < 0.05:
            occurred = ingested + timedelta(hours=5)
        if rng.random() < 0.03:
            occurred = None
        row = (f"e{k}", root, k, "c", f"i{rng.randrange(3)}", k, occurred, ingested, "x", 1)
        rows.append(row)
        if rng.random() < 0.1:
            rows.append((*row[:7], ingested + timedelta(hours=3), "y", 2))
    rng.shuffle(rows)
    return rows


def replay(rows):
    first = {}
    for r in rows:
        if r[0] is None or r[1] is None or r[6] is None or r[7] is None:
            continue
        if r[0] not in first or r[7] < first[r[0]][7]:
            first[r[0]] = r
    out = set()
    hour = lambda t: (t - datetime(1970, 1, 1)) // timedelta(hours=1)
    for r in first.values():
        earlier = [min(o[6], o[7]) for o in first.values() if o[1] == r[1] and o[7] < r[7]]
        event = min(r[6], r[7])
        if earlier and datetime(1970, 1, 1) + timedelta(hours=hour(event) + 1) <= max(earlier):
            out.add((r[1], hour(event), "corrected" if max(earlier) - event <= timedelta(hours=12) else "cut_off"))
    return out


def test_found_as_replayed(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        found = L.late_found(spark.createDataFrame(rows, SCHEMA))
        assert {tuple(r) for r in found.collect()} == replay(rows)


def test_slices_of_any_width_agree(spark):
    frame = spark.createDataFrame(rows_of(3), SCHEMA)
    arrivals = L.first_arrivals(frame)
    one, other = (sorted(map(str, L.with_mark(arrivals, width).collect())) for width in (60, 1_000_000))
    assert one == other


def test_counters_merge_idempotent_and_in_any_order(spark):
    rows = rows_of(4)
    frame = spark.createDataFrame(rows, SCHEMA)
    cells = L.counter_cells(L.classify(L.with_mark(L.first_arrivals(frame))))
    whole = sorted(map(str, L.cell_totals(cells).collect()))
    parts = [cells.where(F.pmod(F.xxhash64("source", "version"), F.lit(3)) == k) for k in range(3)]
    merged = L.merge_cells(parts[2], parts[0], parts[1], parts[0], cells)
    assert sorted(map(str, L.cell_totals(merged).collect())) == whole


def test_versions_without_a_number_or_with_one_given_twice_all_count(spark):
    """Events without sequence numbers, and two of one number, are versions of their own, in whichever state they come."""
    numbers = [None, None, 7, 7, 8]
    rows = [(f"e{k}", "r", n, "c", "i", None, START, START + timedelta(minutes=k), None, None) for k, n in enumerate(numbers)]
    whole = spark.createDataFrame(rows, SCHEMA)
    assert [tuple(r) for r in L.corrected_hours(whole).collect()] == [("r", 484236, 5, 0, 0)]
    cells = [L.counter_cells(L.classify(L.with_mark(L.first_arrivals(spark.createDataFrame(part, SCHEMA))))) for part in (rows[:3], rows[2:], rows[1:4])]
    assert [r.n for r in L.cell_totals(L.merge_cells(*cells)).collect()] == [5]


def test_delivering_again_changes_no_count(spark):
    rows = rows_of(7)
    once = sorted(map(str, L.corrected_hours(spark.createDataFrame(rows, SCHEMA)).collect()))
    again = rows + [(*r[:7], r[7] + timedelta(days=9), *r[8:]) for r in rows if r[7]]
    assert sorted(map(str, L.corrected_hours(spark.createDataFrame(again[::-1], SCHEMA)).collect())) == once


def test_nulls_and_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert L.late_found(none).count() == 0 and L.corrected_hours(none).count() == 0
    nulls = [(None,) * 10, ("e", None, None, None, None, None, None, None, None, None), ("e2", "r", None, None, None, None, START, START, None, None)]
    assert [tuple(r) for r in L.corrected_hours(spark.createDataFrame(nulls, SCHEMA)).collect()] == [("r", 484236, 1, 0, 0)]


def test_equal_arrivals_do_not_mark_each_other(spark):
    rows = [("a", "r", 1, "c", "i", 1, START, START + timedelta(hours=9), None, None), ("b", "r", 2, "c", "i", 2, START + timedelta(hours=8), START + timedelta(hours=9), None, None)]
    assert L.late_found(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_zone_of_the_session_makes_no_difference(spark):
    frame = spark.createDataFrame(rows_of(6), SCHEMA)
    utc = sorted(map(str, L.corrected_hours(frame).collect()))
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert sorted(map(str, L.corrected_hours(frame).collect())) == utc
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
