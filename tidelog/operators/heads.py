"""Entity heads, incremental change detection, and the heads table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def heads(log: DataFrame, snapshots: DataFrame | None = None, entity_type: str | None = None) -> DataFrame:
    """entity_id, entity_type, head_seq: the greatest of an entity's sequences and of its snapshot's event_sequence; unchanged by
    compaction. The events meet in a hash aggregate by entity and type (one row an entity and task is shuffled); only its result, a row
    an entity, goes through the sort-based choice of the type."""
    rows = log.select("entity_id", "entity_type", F.col("sequence").alias("head_seq"))
    if snapshots is not None:
        rows = rows.unionByName(snapshots.select("entity_id", "entity_type", F.col("event_sequence").alias("head_seq")))
    if entity_type:
        rows = rows.where(F.col("entity_type") == entity_type)
    return merge(rows.groupBy("entity_id", "entity_type").agg(F.max("head_seq").alias("head_seq")))


def merge(*tables: DataFrame) -> DataFrame:
    """Heads tables together: the greatest head_seq of an entity, with its type; of equal ones the earlier table's. Rows without
    an id or with head_seq under 1 are ignored."""
    rows = [t.select("entity_id", "entity_type", "head_seq", F.lit(-i).alias("rank")) for i, t in enumerate(tables)]
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    every = every.where("coalesce(entity_id, '') <> '' and head_seq >= 1")
    return every.groupBy("entity_id").agg(
        F.max_by("entity_type", F.struct("head_seq", "rank")).alias("entity_type"), F.max("head_seq").alias("head_seq")
    )


def backfill(current: DataFrame, log: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, int]:
    """The heads table with all heads of the source, and how many those are (unchanged ones too)."""
    source = heads(log, snapshots)
    return merge(current, source), source.count()


def changed(heads: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Heads over their entity's checkpoint; no checkpoint is 0."""
    points = checkpoints.select("entity_id", F.col("checkpoint").alias("__c"))
    return heads.join(points, "entity_id", "left").where(F.col("head_seq") > F.coalesce("__c", F.lit(0))).select(
        *heads.columns, F.coalesce("__c", F.lit(0)).cast("long").alias("checkpoint")
    )


def advance(checkpoints: DataFrame, heads: DataFrame) -> DataFrame:
    """Checkpoints moved up to the given heads; never down."""
    new = heads.select("entity_id", F.col("head_seq").alias("checkpoint"))
    return checkpoints.select("entity_id", "checkpoint").unionByName(new).groupBy("entity_id").agg(F.max("checkpoint").alias("checkpoint"))


def visit(heads: DataFrame, f: Callable[[Row], bool | None]) -> int:
    """Calls ``f`` once for each entity, a partition at a time; stops when it returns False. The number of calls."""
    n = 0
    for row in heads.toLocalIterator(prefetchPartitions=False):
        n += 1
        if f(row) is False:
            break
    return n
