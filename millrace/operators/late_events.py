"""Event-time counts per period that stay right under late, repeated and reordered arrival.

The counts are conflict-free counters.  A *cell* is keyed by stream, period, outcome, source and
version: the source's own sequence number with the event's id, since a number may be missing or be
given twice.  Its value is how many events that version holds.  Counter states merge by the maximum
of each cell, and a period's count is the sum over all versions and sources, so delivering a batch
again, or in another order, changes nothing.  Every count runs through this merge.

A version delivered several times is judged as of its first arrival: before cells are made, the
arrivals of a version merge to the earliest, which is as indifferent to repetition and order.

Lateness needs, for each event, the greatest event time that had arrived in its stream before it.
A stream can hold a third of all rows, so this running maximum is never computed in one task per
stream: arrival time is cut into slices, the maximum runs inside each (stream, slice) and a second,
much smaller running maximum over slice maxima supplies the carry from earlier slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
CELL = ["root_execution_id", "hour_id", "outcome", "source", "version"]


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp column, whatever the session's zone."""
    # From the fields of the local time: a difference of timestamps would go through the session's zone.
    t = F.col(column).cast("timestamp_ntz")
    seconds = F.unix_date(t.cast("date")).cast("long") * 86_400 + F.hour(t) * 3_600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.date_part(F.lit("SECOND"), t) * 1_000_000).cast("long")


def first_arrivals(events: DataFrame) -> DataFrame:
    """One row per event at its first arrival: event_id, stream, source, version, arrival and event time.

    Events without id, stream, ``occurred_at`` or ``ingested_at`` are left out.  Event time is the
    earlier of the two times.  Rows of one event that arrive at the same instant are one arrival.
    """
    narrow = events.select(
        "event_id",
        "root_execution_id",
        F.concat_ws("/", F.coalesce("producer_component", F.lit("")), F.coalesce("producer_instance_id", F.lit(""))).alias("source"),
        F.coalesce(F.col("producer_sequence"), F.col("sequence")).cast("long").alias("version"),
        micros("ingested_at").alias("arrived_us"),
        micros("occurred_at").alias("occurred_us"),
    ).where("event_id is not null and root_execution_id is not null and arrived_us is not null and occurred_us is not null")
    first = narrow.groupBy("event_id").agg(F.min(F.struct("arrived_us", "occurred_us", "root_execution_id", "source", "version")).alias("e"))
    return first.select("event_id", "e.*").select(
        "event_id",
        "root_execution_id",
        "source",
        "version",
        "arrived_us",
        F.least("occurred_us", "arrived_us").alias("event_us"),
    )


def with_mark(arrivals: DataFrame, slice_seconds: int = 600) -> DataFrame:
    """Add ``mark_us``: the greatest event time of the stream among strictly earlier arrivals, or null.

    ``slice_seconds`` bounds the rows of one window task to what one stream receives in that time,
    and the carry to one row per stream and slice.
    """
    sliced = arrivals.withColumn("slice", F.floor(F.col("arrived_us") / (slice_seconds * 1_000_000)))
    key = ["root_execution_id", "slice"]
    inside = Window.partitionBy(*key).orderBy("arrived_us")
    # The rank names every column, so that both uses below need the same rows and share one exchange.
    rank = Window.partitionBy(*key).orderBy("arrived_us", "event_us", "event_id", "source", "version")
    rows = sliced.withColumns(
        {
            "inside_us": F.max("event_us").over(inside.rangeBetween(Window.unboundedPreceding, -1)),
            "slice_us": F.max("event_us").over(Window.partitionBy(*key)),
            "rank": F.row_number().over(rank),
        }
    )
    carry = (
        rows.where("rank = 1")
        .select(
            F.col("root_execution_id").alias("carry_root"),
            F.col("slice").alias("carry_slice"),
            F.max("slice_us")
            .over(Window.partitionBy("root_execution_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
            .alias("carry_us"),
        )
        .where("carry_us is not null")
    )
    joined = rows.join(carry, (rows.root_execution_id == carry.carry_root) & (rows.slice == carry.carry_slice), "left")
    return joined.withColumn("mark_us", F.greatest("inside_us", "carry_us")).select(*arrivals.columns, "mark_us")


def classify(marked: DataFrame, cut_off_hours: int = 12) -> DataFrame:
    """Add ``hour_id`` and ``outcome``: on_time, corrected (late within the cut-off) or cut_off."""
    hour = F.floor(F.col("event_us") / HOUR_US).cast("long")
    late = F.coalesce((hour + 1) * HOUR_US <= F.col("mark_us"), F.lit(False))
    within = F.col("mark_us") - F.col("event_us") <= cut_off_hours * HOUR_US
    outcome = F.when(~late, "on_time").when(within, "corrected").otherwise("cut_off")
    return marked.withColumns({"hour_id": hour, "outcome": outcome})


def counter_cells(classified: DataFrame) -> DataFrame:
    """Counter state of a set of first arrivals: one cell per stream, hour, outcome, source and version.

    No rows meet here: a version is one event, and states that hold it twice merge later.
    """
    return classified.select(
        "root_execution_id",
        "hour_id",
        "outcome",
        "source",
        F.concat_ws(":", F.col("version").cast("string"), "event_id").alias("version"),
        F.lit(1).cast("long").alias("n"),
    )


def merge_cells(*states: DataFrame) -> DataFrame:
    """Join of counter states: the maximum of each cell.  Commutative, associative and idempotent."""
    union = states[0]
    for state in states[1:]:
        union = union.unionByName(state)
    return union.groupBy(*CELL).agg(F.max("n").alias("n"))


def cell_totals(cells: DataFrame) -> DataFrame:
    """Counts per stream, hour and outcome of a merged state: the sum over sources and versions.

    Summed where they lie first, so that a stream with a third of all events is no single task.
    """
    return cells.groupBy("root_execution_id", "hour_id", "outcome").agg(F.sum("n").alias("n"))


def late_counts(events: DataFrame, cut_off_hours: int = 12, slice_seconds: int = 600) -> DataFrame:
    """Counts per root_execution_id, hour_id and outcome over all events of the log.

    An empty log gives no rows; extra columns of the input are ignored.
    """
    classified = classify(with_mark(first_arrivals(events), slice_seconds), cut_off_hours)
    return cell_totals(merge_cells(counter_cells(classified)))


def late_found(events: DataFrame, cut_off_hours: int = 12) -> DataFrame:
    """Stream, hour and outcome of each hour with at least one late event."""
    totals = late_counts(events, cut_off_hours)
    return totals.where("outcome <> 'on_time' and n > 0").select("root_execution_id", "hour_id", "outcome")


def corrected_hours(events: DataFrame, cut_off_hours: int = 12) -> DataFrame:
    """Per stream and hour: events counted, how many of them came late, and how many were left out."""
    totals = late_counts(events, cut_off_hours)

    def of(*outcomes: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("outcome").isin(*outcomes), F.col("n"))), F.lit(0)).cast("long")

    return totals.groupBy("root_execution_id", "hour_id").agg(
        of("on_time", "corrected").alias("n_counted"),
        of("corrected").alias("n_corrected"),
        of("cut_off").alias("n_left_out"),
    )
