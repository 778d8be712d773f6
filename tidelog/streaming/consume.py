"""Projectors over a stream: idempotent consumption, partial failures, and tables kept by streams."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.policy import PERMANENT, UNKNOWN, Classified
from ..operators import heads as H
from ..operators import views as V
from ..sources.log import decode_envelopes
from ..sources.store import Store

log = logging.getLogger(__name__)

#: A projector takes the pending records and returns the event_id column of those that failed (None: none did). It raises
#: Classified with class permanent to fail all for good, anything else to have the batch delivered again.
Projector = Callable[[DataFrame], DataFrame | None]


def pending(records: DataFrame, processed: DataFrame, projector: str) -> DataFrame:
    """Records that the projector has not processed. Repeats within ``records`` stay."""
    return records.join(processed.where(F.col("projector") == projector).select("event_id"), "event_id", "left_anti")


def process(store: Store, name: str, projector: Projector, records: DataFrame, dedupe: bool = False) -> DataFrame:
    """Runs a batch through a projector and returns the event_ids that failed. Those that didn't are marked processed, in the same
    way on every redelivery. If the processed table can't be read, all records go through; if it can't be written, the batch is done
    nonetheless and may come again. ``dedupe``: a record once a batch."""
    once = (lambda rows: rows.dropDuplicates(["event_id"])) if dedupe else (lambda rows: rows)
    try:
        rows = once(pending(records, store.read("processed"), name)).persist()
        count = rows.count()  # reads the guard now, not in the projector
    except Exception:  # noqa: BLE001  a guard that can't be read must not stop the stream
        rows = once(records).persist()
        count = rows.count()
    try:
        none = rows.select("event_id").limit(0)
        if not count:
            return none
        try:
            failed = projector(rows)
        except Classified as e:
            if e.kind != PERMANENT:
                raise
            return rows.select("event_id").distinct()
        failed = (none if failed is None else failed.select("event_id").distinct()).persist()
        failed.count()  # a projector that fails only now fails the batch
        done = rows.select(F.lit(name).alias("projector"), "event_id").join(failed, "event_id", "left_anti")
        try:
            store.mark_processed(done)
        except Exception as e:  # noqa: BLE001  the records were projected; at worst they come again
            log.warning("%s: events could not be marked as processed: %s", name, e)
        return failed
    finally:
        rows.unpersist()


def queue_failures(store: Store, name: str, projector: Projector, messages: DataFrame) -> DataFrame:
    """Handles queue messages (message_id, message) in envelopes; returns the message_ids to deliver again. Messages that can't be
    decoded are dropped; of messages with the same event the last (greatest message_id) answers for it."""
    decoded = decode_envelopes(messages).where("reject is null")
    failed = process(store, name, projector, decoded.drop("reject"))
    by_event = decoded.groupBy("event_id").agg(F.max("message_id").alias("message_id"))
    return by_event.join(failed, "event_id", "left_semi").select("message_id")


def topic_batch(store: Store, name: str, projector: Projector, messages: DataFrame) -> None:
    """Handles topic messages: any failure fails the whole batch."""
    decoded = decode_envelopes(messages).where("reject is null")
    failed = process(store, name, projector, decoded.drop("reject")).limit(5).collect()
    if failed:
        raise Classified(UNKNOWN, RuntimeError(f"{len(failed)} or more records failed: {[r.event_id for r in failed]}"))


def run(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, **trigger) -> StreamingQuery:
    """A streaming query that gives each micro-batch to ``handle``; by default it takes what is there and ends."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def keep_heads(store: Store, log_stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Keeps the heads table from a stream of events. Redelivery and disorder change nothing: heads only rise."""
    return run(log_stream, lambda df, _: store.put_heads(H.heads(df)), checkpoint, **trigger)


def keep_views(
    store: Store, log_stream: DataFrame, project: Callable[[DataFrame], DataFrame], checkpoint: str, **trigger
) -> StreamingQuery:
    """Keeps views from a stream: ``project`` turns a batch of events into views with ``arrival`` (their sequence)."""
    return run(log_stream, lambda df, _: store.put_views(project(df)), checkpoint, **trigger)


def keep_projected(store: Store, name: str, projector: Projector, records: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Runs a projector over a stream of records with the idempotency guard."""
    return run(records, lambda df, _: process(store, name, projector, df), checkpoint, **trigger)


def read_stream(spark: SparkSession, path: str, schema, files: int = 1000) -> DataFrame:
    """Inserts of an append-only folder of Parquet files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


__all__ = [
    "H", "V", "keep_heads", "keep_projected", "keep_views", "pending", "process", "queue_failures", "read_stream", "run", "topic_batch"
]
