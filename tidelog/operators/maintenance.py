"""Compaction, retention and checks of the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def compaction_status(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """status of each request (entity_id, through): noop if through is under 1, uncovered if no snapshot reaches it, else ok."""
    floors = snapshots.select("entity_id", F.col("event_sequence").alias("__floor"))
    status = F.when(F.col("through") < 1, "noop").when(F.coalesce("__floor", F.lit(0)) < F.col("through"), "uncovered").otherwise("ok")
    return requests.join(floors, "entity_id", "left").select(*requests.columns, status.alias("status"))


def compact(log: DataFrame, requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """The log without the events that covered requests name; refused requests delete nothing. Snapshots are untouched, and the
    same request again deletes nothing more."""
    ok = compaction_status(requests, snapshots).where("status = 'ok'").groupBy("entity_id").agg(F.max("through").alias("__through"))
    return log.join(ok, "entity_id", "left").where(F.col("__through").isNull() | (F.col("sequence") > F.col("__through"))).drop("__through")


def compaction_counts(log: DataFrame, requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Requests with status and deleted: the events that each deletes."""
    status = compaction_status(requests, snapshots)
    hits = log.select("entity_id", "sequence").join(
        status.where("status = 'ok'").select("entity_id", "through"), "entity_id"
    ).where("sequence <= through").groupBy("entity_id", "through").agg(F.count("*").alias("__n"))
    return status.join(hits, ["entity_id", "through"], "left").select(
        *status.columns, F.coalesce("__n", F.lit(0)).cast("long").alias("deleted")
    )


def ttl(entity_type: Column, policies: dict[str, int], now: Column) -> Column:
    """Unix second at which a row of the type expires; null for types without a policy or with one that is not positive."""
    out = F.lit(None).cast("long")
    for name, seconds in policies.items():
        if seconds > 0:
            out = F.when(entity_type == name, C.unix_seconds(now) + seconds).otherwise(out)
    return out


def expire(rows: DataFrame, now_seconds: int | Column) -> DataFrame:
    """Rows that are not expired. Each expires alone, so a stream's start may go; reads never do this by themselves."""
    now = F.lit(now_seconds) if isinstance(now_seconds, int) else now_seconds
    return rows.where(F.col("ttl").isNull() | (F.col("ttl") > now))


def gaps(log: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """entity_id, after, before: sequences that are missing between two others, and before the first one above the snapshot."""
    rows = log.select("entity_id", "sequence").distinct()
    if snapshots is not None:
        floors = snapshots.select("entity_id", F.col("event_sequence").alias("__floor"))
        rows = rows.join(floors, "entity_id", "left").where(F.col("sequence") > F.coalesce("__floor", F.lit(0))).withColumn(
            "__floor", F.coalesce("__floor", F.lit(0))
        )
    else:
        rows = rows.withColumn("__floor", F.lit(0))
    before = F.coalesce(F.lag("sequence").over(Window.partitionBy("entity_id").orderBy("sequence")), F.col("__floor"))
    return rows.withColumn("after", before.cast("long")).where(F.col("sequence") > F.col("after") + 1).select(
        "entity_id", "after", F.col("sequence").alias("before")
    )


def gappy(log: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """entity_id, missing: how many sequences above the snapshot are missing. An aggregate only, so a very long stream is no
    load on one task."""
    rows = log.select("entity_id", "sequence")
    floor = F.lit(0)
    if snapshots is not None:
        rows = rows.join(
            snapshots.select("entity_id", F.col("event_sequence").alias("__floor")), "entity_id", "left"
        ).where(F.col("sequence") > F.coalesce("__floor", F.lit(0)))
        floor = F.coalesce(F.max("__floor"), F.lit(0))
    counted = rows.distinct().groupBy("entity_id").agg((F.max("sequence") - floor - F.count("*")).cast("long").alias("missing"))
    return counted.where("missing > 0")
