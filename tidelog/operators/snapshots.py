"""Snapshots: when a commit takes one, building and upserting them, replay debt."""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

#: Milliseconds that replaying an event is taken to cost.
MS_PER_EVENT = 8.0


def decision(current: Column, new: Column, most: Column) -> Column:
    """Events of a commit that its snapshot covers: all ``new`` if they reach the next multiple of ``most`` after ``current``,
    else 0; 0 if ``most`` is not positive."""
    return F.when(most <= 0, 0).when(new < most - F.when(most > 0, current % most), 0).otherwise(new).cast("long")


def size_for(entity_type: Column, sizes: dict[str, int], default: int) -> Column:
    """The snapshot interval of a type."""
    out = F.lit(default)
    for name, n in sizes.items():
        out = F.when(entity_type == name, n).otherwise(out)
    return out


def commits(log: DataFrame) -> DataFrame:
    """entity_id, entity_type, commit_id, cur (sequence before), n, last_seq of each commit."""
    grouped = log.groupBy("entity_id", "commit_id").agg(
        F.first("entity_type").alias("entity_type"), F.min("sequence").alias("lo"), F.count("*").alias("n"),
        F.max("sequence").alias("last_seq")
    )
    return grouped.select("entity_id", "entity_type", "commit_id", (F.col("lo") - 1).alias("cur"), "n", "last_seq")


def taken(log: DataFrame, size: int | Column = 5) -> DataFrame:
    """Commits with ``take``: the events that the commit's snapshot covers, 0 for none."""
    return commits(log).withColumn("take", decision(F.col("cur"), F.col("n"), F.lit(size) if isinstance(size, int) else size))


def floors(log: DataFrame, size: int | Column = 5) -> DataFrame:
    """entity_id, entity_type, sequence (number of snapshots taken), event_sequence (last event covered)."""
    done = taken(log, size).where("take > 0")
    return done.groupBy("entity_id").agg(
        F.first("entity_type").alias("entity_type"), F.count("*").alias("sequence"), F.max("last_seq").alias("event_sequence")
    )


def upsert(current: DataFrame, incoming: DataFrame, arrival: str = "arrival") -> DataFrame:
    """One snapshot an entity: the one with the greatest event_sequence; of equal ones the later arrival, and incoming over
    current. A lower one changes nothing. incoming has the columns of current and ``arrival``. Summed per task before the
    shuffle."""
    cols = [c for c in current.columns if c not in ("entity_id", "event_sequence")]
    old = current.select("entity_id", "event_sequence", F.lit(0).alias("__new"), F.lit(0).cast("long").alias("__at"), *cols)
    new = incoming.select("entity_id", "event_sequence", F.lit(1).alias("__new"), F.col(arrival).cast("long").alias("__at"), *cols)
    best = old.unionByName(new).groupBy("entity_id").agg(F.max_by(
        F.struct("event_sequence", *cols), F.struct("event_sequence", "__new", "__at")
    ).alias("b"))
    return best.select("entity_id", "b.*").select(*current.columns)


def freshness(log: DataFrame, snapshots: DataFrame, budget: int = 0, ms: float = MS_PER_EVENT) -> DataFrame:
    """Replay debt of each entity with events or a snapshot: since (events after the snapshot), estimate_ms, exceeded (a positive
    budget is passed). ms that is not positive is replaced by the default."""
    ms = ms if ms > 0 else MS_PER_EVENT
    f = snapshots.select("entity_id", "event_sequence")
    n = log.select("entity_id", "sequence").join(f, "entity_id", "full").groupBy("entity_id").agg(
        F.max("event_sequence").alias("event_sequence"), F.max("sequence").alias("last"), F.count(F.when(
            F.col("sequence") > F.coalesce("event_sequence", F.lit(0)), 1
        )).alias("since")
    )
    head = F.greatest(F.coalesce("last", F.lit(0)), F.coalesce("event_sequence", F.lit(0)))
    return n.select(
        "entity_id", head.alias("head_seq"), F.coalesce("event_sequence", F.lit(0)).alias("event_sequence"), "since",
        F.round(F.col("since") * F.lit(float(ms))).cast("long").alias("estimate_ms"),
        ((F.lit(budget) > 0) & (F.col("since") > budget)).alias("exceeded")
    )


def observe(debts: DataFrame, observer: Callable[[Row], None]) -> int:
    """Gives the debt of each entity to ``observer``, a partition at a time; what an observer raises doesn't stop the others. The
    number of calls."""
    n = 0
    for row in debts.toLocalIterator():
        n += 1
        with contextlib.suppress(Exception):
            observer(row)
    return n


def catch_up(states: DataFrame, snapshots: DataFrame, debts: DataFrame, threshold: int) -> DataFrame:
    """New snapshots for entities with a debt of at least ``threshold`` (none if it is not positive). states: entity_id,
    entity_type, head_seq, payload. Their ordinal is one over the last."""
    due = debts.where((F.lit(threshold) > 0) & (F.col("since") >= threshold)).select("entity_id")
    last = snapshots.select("entity_id", F.col("sequence").alias("__n"))
    rows = states.join(due, "entity_id", "left_semi").join(last, "entity_id", "left")
    return rows.select(
        "entity_id", "entity_type", (F.coalesce("__n", F.lit(0)) + 1).cast("long").alias("sequence"),
        F.col("head_seq").alias("event_sequence"), "payload"
    )
