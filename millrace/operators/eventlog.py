"""Execution queue and event log: claim order, numbering, redelivery, order checks, state by folding.

Checks over a log partition by its root.  A root may hold a third of all events, so gaps and order
are found by an equi-join of neighbouring sequence numbers and by partial aggregates, not by a window
over one root; what needs the order of all of a root's events runs in slices of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.sliced import with_position, with_previous

#: Numbers, and seconds, of one slice of a root's order.
SLICE_NUMBERS = 65_536
SLICE_SECONDS = 600


def priority_rank(priority: str = "priority") -> Column:
    return F.when(F.col(priority) == "high", 0).when(F.col(priority) == "normal", 1).otherwise(2)


def claim_order(executions: DataFrame, now: Column, types: list[str] | None = None, most: int = 100) -> DataFrame:
    """Queued executions that may start, in the order of claims: high, normal, background, then by time.

    Background ones wait while high or normal ones are queued, but for the hours from 2 to 6.
    """
    queued = executions.where(F.col("status") == "queued")
    waiting = queued.agg(F.count_if(F.col("priority").isin("high", "normal")).alias("waiting"))
    ready = queued.where(F.col("available_at") <= now)
    if types is not None:
        ready = ready.where(F.col("task_type").isin(types))
    idle = ((F.hour(now) >= 2) & (F.hour(now) < 6)) | (F.col("waiting") == 0)
    eligible = ready.join(F.broadcast(waiting), how="cross").where(F.col("priority").isin("high", "normal") | ((F.col("priority") == "background") & idle)).drop("waiting")
    return eligible.orderBy(priority_rank(), "available_at", F.col("created_at").asc_nulls_last(), "execution_id").limit(most)


def queue_counts(executions: DataFrame) -> DataFrame:
    return executions.where("status = 'queued'").groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def deduplicated(events: DataFrame) -> DataFrame:
    """One row per event id, its first arrival; rows without id are left out."""
    columns = [c for c in events.columns if c != "event_id"]
    first = F.min_by(F.struct(*columns), F.struct("ingested_at", F.xxhash64(*columns)))
    return events.where("event_id is not null").groupBy("event_id").agg(first.alias("e")).select("event_id", "e.*")


def sequence_gaps(events: DataFrame) -> DataFrame:
    """root_execution_id, after_sequence, next_sequence of every gap in a root's numbers."""
    numbers = events.where("root_execution_id is not null and sequence is not null").select("root_execution_id", "sequence").distinct()
    follows = numbers.select("root_execution_id", (F.col("sequence") - 1).alias("sequence"))
    ends = numbers.join(follows, ["root_execution_id", "sequence"], "left_anti").select("root_execution_id", F.col("sequence").alias("e"), F.lit(0).alias("k"))
    precedes = numbers.select("root_execution_id", (F.col("sequence") + 1).alias("sequence"))
    starts = numbers.join(precedes, ["root_execution_id", "sequence"], "left_anti").select("root_execution_id", F.col("sequence").alias("e"), F.lit(1).alias("k"))
    # Only the ends of unbroken runs meet in the window: two rows per gap.
    run = Window.partitionBy("root_execution_id").orderBy("e", F.desc("k"))
    paired = ends.unionByName(starts).withColumn("next_sequence", F.lead("e").over(run))
    return paired.where("k = 0 and next_sequence is not null").select("root_execution_id", F.col("e").alias("after_sequence"), "next_sequence")


def log_summary(events: DataFrame) -> DataFrame:
    """Per root: events, first and last number, whether the numbers are unbroken and unique, producers, executions."""
    rows = events.where("root_execution_id is not null").groupBy("root_execution_id").agg(
        F.count_distinct("event_id").alias("n_events"),
        F.min("sequence").alias("first_sequence"),
        F.max("sequence").alias("last_sequence"),
        F.count_distinct("sequence").alias("n_sequences"),
        F.count_distinct("producer_instance_id").alias("n_producers"),
        F.count_distinct("execution_id").alias("n_executions"),
    )
    return rows.withColumns(
        {
            "contiguous": F.col("last_sequence") - F.col("first_sequence") + 1 == F.col("n_sequences"),
            "unique": F.col("n_events") == F.col("n_sequences"),
        }
    )


def cause_violations(events: DataFrame) -> DataFrame:
    """event_id, problem of events whose cause is unknown in their root or doesn't come before them."""
    one = deduplicated_keys(events)
    causes = one.select(F.col("event_id").alias("caused_by_event_id"), F.col("root_execution_id").alias("cause_root"), F.col("sequence").alias("cause_sequence"))
    joined = one.where("caused_by_event_id is not null").join(causes, "caused_by_event_id", "left")
    missing = F.col("cause_root").isNull() | (F.col("cause_root") != F.col("root_execution_id"))
    problem = F.when(missing, "unknown_cause").when(F.col("cause_sequence") >= F.col("sequence"), "cause_not_before")
    return joined.select("event_id", problem.alias("problem")).where("problem is not null")


def deduplicated_keys(events: DataFrame) -> DataFrame:
    """event_id, root, number and cause of each event, once."""
    keys = ["root_execution_id", "sequence", "caused_by_event_id"]
    return events.where("event_id is not null").groupBy("event_id").agg(*(F.min(c).alias(c) for c in keys))


def producer_order(events: DataFrame) -> DataFrame:
    """event_id of events whose producer number isn't above that of the event before in the same stream of a root."""
    keys = ["root_execution_id", "producer_component", "producer_instance_id"]
    one = events.where("event_id is not null and sequence is not null and producer_sequence is not null").groupBy("event_id").agg(*(F.min(c).alias(c) for c in (*keys, "sequence", "producer_sequence")))
    ordered = with_previous(one, keys, F.floor(F.col("sequence") / SLICE_NUMBERS), ["sequence", "event_id"], "producer_sequence", "last")
    return ordered.where("producer_sequence <= last").select("event_id")


def open_operations(events: DataFrame) -> DataFrame:
    """root_execution_id, operation_id of operations that started and never finished."""
    started = events.where("event_type = 'operation.started' and operation_id is not null").select("root_execution_id", "operation_id").distinct()
    finished = events.where("event_type = 'operation.finished' and operation_id is not null").select("root_execution_id", "operation_id").distinct()
    return started.join(finished, ["root_execution_id", "operation_id"], "left_anti")


def next_producer_sequence(events: DataFrame) -> DataFrame:
    """The number each producer stream of a root writes next."""
    keys = ["root_execution_id", "producer_component", "producer_instance_id"]
    return events.groupBy(*keys).agg((F.coalesce(F.max("producer_sequence"), F.lit(0)) + 1).alias("next_sequence"))


def appended(log: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh events numbered behind a log: sequence per root, producer_sequence per stream, cause and content hash.

    ``fresh`` is one batch with event_id, root_execution_id, producer_component, producer_instance_id,
    event_type, occurred_at and payload; it is numbered by occurred_at, then by event_id.  An event's cause
    is the one before it in its root.  Events that the log already has are left out.
    """
    stream = ["root_execution_id", "producer_component", "producer_instance_id"]
    new = fresh.join(log.select("event_id").distinct(), "event_id", "left_anti").dropDuplicates(["event_id"])
    roots = new.select("root_execution_id").distinct()
    known = log.join(roots, "root_execution_id", "left_semi")
    last = known.groupBy("root_execution_id").agg(F.max("sequence").alias("last_sequence"), F.max_by("event_id", F.struct("sequence", "event_id")).alias("last_event_id"))
    last_own = known.groupBy(*stream).agg(F.max("producer_sequence").alias("last_own"))
    order = ["occurred_at", "event_id"]
    # Slices of time; events without a time come first, as in the order.
    slice_of = F.coalesce(F.floor(F.unix_micros(F.col("occurred_at").cast("timestamp")) / (SLICE_SECONDS * 1_000_000)), F.lit(-(1 << 62)))
    rows = with_position(new, ["root_execution_id"], slice_of, [F.col(c) for c in order], "place")
    rows = with_previous(rows, ["root_execution_id"], slice_of, order, "event_id", "event_before")
    rows = with_position(rows, stream, slice_of, [F.col(c) for c in order], "own_place")
    rows = rows.join(last, "root_execution_id", "left").join(last_own, stream, "left")
    rows = rows.withColumns(
        {
            "sequence": F.coalesce("last_sequence", F.lit(0)) + F.col("place"),
            "producer_sequence": F.coalesce("last_own", F.lit(0)) + F.col("own_place"),
            "caused_by_event_id": F.coalesce("event_before", "last_event_id"),
        }
    ).drop("place", "own_place", "event_before")
    body = F.to_json(F.struct("caused_by_event_id", "event_id", "event_type", "payload", "producer_sequence", "root_execution_id", "sequence"))
    return rows.drop("last_sequence", "last_event_id", "last_own").withColumn("content_hash", F.concat(F.lit("sha256:"), F.sha2(body, 256)))


def latest_state(events: DataFrame) -> DataFrame:
    """execution_id, event_type, sequence of each execution's last event; ties go to the greater event id."""
    rows = events.where("execution_id is not null and sequence is not null")
    return rows.groupBy("execution_id").agg(F.max(F.struct("sequence", "event_id", "event_type")).alias("m")).select("execution_id", "m.event_type", "m.sequence")


def fenced(updates: DataFrame, owners: DataFrame) -> DataFrame:
    """Updates whose attempt still owns the execution; those of stale attempts are dropped."""
    return updates.join(owners.select("execution_id", "attempt_id").distinct(), ["execution_id", "attempt_id"], "left_semi")


def hash_chain_breaks(events: DataFrame) -> DataFrame:
    """Events of one id with different content hashes: event_id, n_hashes."""
    return events.where("event_id is not null").groupBy("event_id").agg(F.count_distinct("content_hash").alias("n_hashes")).where("n_hashes > 1")


# States that end an execution.
END_STATES = ("completed", "failed", "cancelled")


def repeated_ends(events: DataFrame) -> DataFrame:
    """root_execution_id, execution_id, n_ends of executions whose events bring them to an end more than once.

    Redelivered events count once; events without execution or with an unreadable envelope don't count.
    """
    moves = events.where("event_type = 'execution.state_changed' and event_id is not null and execution_id is not null")
    ends = moves.select("event_id", "root_execution_id", "execution_id", F.get_json_object("envelope", "$.payload.to").alias("state")).where(F.col("state").isin(*END_STATES)).distinct()
    return ends.groupBy("root_execution_id", "execution_id").agg(F.count_distinct("event_id").alias("n_ends")).where("n_ends > 1")


def _reports(events: DataFrame, *columns: Column) -> DataFrame:
    rows = events.where("event_type = 'progress.reported' and event_id is not null and execution_id is not null and envelope is not null")
    return rows.select("event_id", "execution_id", "sequence", *columns).dropDuplicates(["event_id"])


def progress(events: DataFrame) -> DataFrame:
    """execution_id, n_reports, n_ledgers: progress reports of each execution, once each, and those with a ledger."""
    kind = F.get_json_object("envelope", "$.payload.kind").alias("kind")
    return _reports(events, kind).groupBy("execution_id").agg(F.count(F.lit(1)).alias("n_reports"), F.count_if(F.col("kind") == "ledger_snapshot").alias("n_ledgers"))


def ledgers(events: DataFrame) -> DataFrame:
    """execution_id, bucket, used, reserved of each execution's last ledger, replayed from its reports.

    The last report by sequence, then event id, counts.  Entries and reservations may be lists, single
    objects, or either as a string; entries without a bucket are left out, several of one bucket add up.
    """
    reports = _reports(events, F.get_json_object("envelope", "$.payload.ledger.entries").alias("entries")).where("entries is not null")
    last = reports.groupBy("execution_id").agg(F.max_by("entries", F.struct("sequence", "event_id")).alias("entries"))
    entry = last.select("execution_id", F.explode(F.from_json("entries", "array<struct<bucket string, used long, reservations string>>")).alias("e")).where("e.bucket is not null")
    units = F.aggregate(F.from_json("e.reservations", "array<struct<units long>>"), F.lit(0).cast("long"), lambda n, r: n + F.coalesce(r["units"], F.lit(0)))
    return entry.groupBy("execution_id", F.col("e.bucket").alias("bucket")).agg(F.sum(F.coalesce("e.used", F.lit(0))).alias("used"), F.sum(F.coalesce(units, F.lit(0))).alias("reserved"))
