"""Publishing committed events: validity, envelopes, attributes, routing, budgets, delivery status."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators.evolve import invalid_reason

#: Messages of a transport call, and the default budgets a minute.
BATCH, INGRESS, RETRIES = 10, 300, 60
#: Micro-tokens of a budget: one event costs a minute of microseconds, a rate r refills r a microsecond.
_COST = 60_000_000


def event_json(
    id_: Column, sequence: Column, type_: Column, version: Column, entity_id: Column, entity_type: Column, payload: Column, metadata: Column
) -> Column:
    """The event as it goes on the wire; the payload is base64, metadata its JSON."""
    head = C.to_json(F.struct(
        id_.alias("id"), sequence.alias("sequence"), type_.alias("type"), version.alias("version"), entity_id.alias("entityId"),
        entity_type.alias("entityType"), C.b64(F.encode(payload, "utf-8")).alias("payload")
    ))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"metadata":'), metadata, F.lit("}"))


def envelope(source: str, id_: Column, type_: Column, detail: Column) -> Column:
    """{"id", "source", "detail-type", "detail"}: the event as an envelope's detail."""
    head = C.to_json(F.struct(id_.alias("id"), F.lit(source).alias("source"), type_.alias("detail-type")))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"detail":'), detail, F.lit("}"))


def attributes(entity_type: Column, event_type: Column, command_id: Column, traceparent: Column) -> Column:
    """Message attributes as a map: entityType, eventType, commandId, traceparent, and correlationId (the command id, else the
    traceparent); blank ones are left out."""
    filled = lambda c: F.when(c.isNotNull() & (c != ""), c)
    pairs = [
        ("entityType", entity_type), ("eventType", event_type), ("commandId", filled(command_id)), ("traceparent", filled(traceparent)),
        ("correlationId", F.coalesce(filled(command_id), filled(traceparent)))
    ]
    made = F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(v for _, v in pairs)))
    return F.map_filter(made, lambda k, v: v.isNotNull())


def prepared(changes: DataFrame, source: str, group_id: Callable[[DataFrame], Column] | None = None) -> DataFrame:
    """A row for each change record: item_id, kind (ignored: no insert; skipped: no image; malformed; ready), reason, event_id,
    entity_id, message, attributes, and with ``group_id`` group_id and dedup_id (the event id) of the ordered topic."""
    image = F.col("new_image")
    out = changes.withColumn("item_id", F.coalesce(F.when(F.col("sequence_number") != "", F.col("sequence_number")), F.col("event_id")))
    reason = F.when(image.isNull(), F.lit(None).cast("string")).otherwise(invalid_reason(image["metadata"]))
    kind = F.when(
        F.col("event_name") != "INSERT", "ignored"
    ).when(image.isNull(), "skipped").when(reason.isNotNull(), "malformed").otherwise("ready")
    id_ = C.event_id(image["pk"], image["sk"])
    detail = event_json(
        id_, image["sk"], image["type"], image["version"], image["pk"], image["entityType"], image["payload"], image["metadata"]
    )
    meta = F.from_json(image["metadata"], "commandId string, trace map<string,string>")
    ready = kind == "ready"
    cols = {
        "kind": kind, "reason": reason, "key": id_, "entity_id": image["pk"],
        "message": F.when(ready, envelope(source, id_, image["type"], detail)),
        "attributes": F.when(ready, attributes(image["entityType"], image["type"], meta["commandId"], meta["trace"]["traceparent"])),
    }
    out = out.withColumns(cols)
    if group_id is not None:
        group = F.when(F.col("kind") == "ready", group_id(out))
        out = out.withColumn("group_id", F.when(group != "", group)).withColumn(
            "dedup_id", F.when(F.col("group_id").isNotNull(), F.col("key"))
        )
    return out


def batches(ready: DataFrame, order: str, lane: str, size: int = BATCH) -> DataFrame:
    """Adds batch: groups of ``size`` in order, within each lane (a column; the transport's parallel streams, which are what is numbered:
    all rows as one lane would be one task)."""
    w = Window.partitionBy(lane).orderBy(order)
    return ready.withColumn("batch", F.floor((F.row_number().over(w) - 1) / size).cast("long"))


def ordered_targets(ready: DataFrame) -> DataFrame:
    """Messages of the ordered topic: those with a group, once for each dedup id."""
    return ready.where("group_id is not null").dropDuplicates(["dedup_id"])


class Bucket:
    """A token bucket of ``rate`` a minute, full at the start, refilled continuously, exact in integers. A rate under 1 allows all; a
    clock that goes back refills nothing."""

    def __init__(self, rate: int, now: int):
        self.rate, self.last, self.full = rate, now, rate * _COST
        self.tokens = self.full

    def allow(self, now: int) -> bool:
        if self.rate <= 0:
            return True
        if now > self.last:
            self.tokens, self.last = min(self.full, self.tokens + (now - self.last) * self.rate), now
        if self.tokens < _COST:
            return False
        self.tokens -= _COST
        return True


def token_bucket(rows: DataFrame, key: str, ts: str, rate: int, *order: str) -> DataFrame:
    """Adds allowed: a bucket for each key, taken in order of (ts, order). Keys are dealt out by a shuffle, rows read in order; one
    bucket is held at a time. A budget for all together is a key of one value, or the rate split over keys."""
    schema = T.StructType([*rows.schema, T.StructField("allowed", T.BooleanType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, bucket = None, None
        for frame in frames:
            flags = []
            for k, t in zip(frame[key], frame["__us"], strict=True):
                if bucket is None or k != own:
                    own, bucket = k, Bucket(rate, t)
                flags.append(bucket.allow(t))
            yield frame.drop(columns="__us").assign(allowed=flags)

    ordered = C.dealt(rows.withColumn("__us", F.unix_micros(F.col(ts).cast("timestamp"))), key, "__us", *order)
    return ordered.mapInPandas(run, schema)


def token_bucket_stream(rows: DataFrame, key: str, ts: str, rate: int, *keep: str) -> DataFrame:
    """As ``token_bucket`` over a stream: the bucket of each key is the query's state, rows of a micro-batch are taken in order of
    ``ts``. Gives the key, ``ts``, the columns ``keep`` and allowed."""
    rows = rows.select(key, F.col(ts).cast("timestamp").alias(ts), *keep).withColumn("__us", F.unix_micros(ts))
    schema = T.StructType([*rows.drop("__us").schema, T.StructField("allowed", T.BooleanType())])
    state = T.StructType([T.StructField("tokens", T.LongType()), T.StructField("last", T.LongType())])

    def run(_, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(frames)).sort_values("__us", kind="stable")
        bucket = Bucket(rate, int(frame["__us"].iloc[0]))
        if held.exists:
            bucket.tokens, bucket.last = held.get
        flags = [bucket.allow(int(t)) for t in frame["__us"]]
        held.update((bucket.tokens, bucket.last))
        yield frame.drop(columns="__us").assign(allowed=flags)

    return rows.groupBy(key).applyInPandasWithState(run, schema, state, "append", "NoTimeout")


def publish(
    prepared_rows: DataFrame,
    send: Callable[[DataFrame], DataFrame],
    send_ordered: Callable[[DataFrame], DataFrame] | None = None,
    throttled: Column | None = None,
    retry_allowed: Column | None = None,
) -> DataFrame:
    """Status of each prepared row: ignored, skipped, throttled (a failure to report), malformed, published, failed (to report) or
    dropped (failed without retry budget; kept here, not reported).

    send gets the ready rows and returns the key column of those that failed; send_ordered, called first, those with a group, each
    dedup id once. A row that failed in either has failed."""
    rows = prepared_rows.withColumn(
        "status",
        F.when(F.col("kind") != "ready", F.col("kind")).when(
            F.coalesce(throttled, F.lit(False)) if throttled is not None else F.lit(False), "throttled"
        )
    )
    out = rows.where("status is null")
    failed = _sent(out, send, send_ordered).withColumn("__failed", F.lit(True))
    again = F.lit(True) if retry_allowed is None else retry_allowed
    status = F.when(
        F.col("status").isNotNull(), F.col("status")
    ).when(F.col("__failed").isNull(), "published").when(again, "failed").otherwise("dropped")
    return rows.join(failed, "key", "left").withColumn("status", status).drop("__failed")


def _sent(ready: DataFrame, send: Callable, send_ordered: Callable | None) -> DataFrame:
    """Distinct keys of the rows that failed in one of the topics; the ordered one comes first, so that a failure there sends again what
    its dedup ids absorb."""
    failed = send_ordered(ordered_targets(ready)).select("key") if send_ordered else None
    second = send(ready).select("key")
    return (second if failed is None else failed.union(second)).distinct()


def handle(
    prepared_rows: DataFrame,
    send: Callable[[DataFrame], DataFrame],
    send_ordered: Callable[[DataFrame], DataFrame] | None = None,
    lane: str = "entity_id",
    ts: str = "ts",
    order: tuple[str, ...] = ("item_id",),
    ingress: int = INGRESS,
    retries: int = RETRIES,
) -> DataFrame:
    """The publisher as a whole: ``prepared`` rows with their status, as ``publish`` gives it.

    Inserts with an image, malformed ones too, take a token of the ingress budget, in order of (``ts``, ``order``); those that get
    none are throttled and reported. Malformed ones are then dropped, the others sent (ordered topic first, a dedup id once). What
    failed takes a token of the retry budget in the same order: with one it is reported, without one dropped. Both budgets are
    buckets of their rate a minute for each ``lane``, full at its first row; a rate under 1 allows all."""
    rows = prepared_rows
    asking = rows.where("kind in ('malformed', 'ready')")
    allowed = token_bucket(asking, lane, ts, ingress, *order)
    status = F.when(~F.col("allowed"), "throttled").when(F.col("kind") == "malformed", "malformed")
    first = allowed.withColumn("status", status).drop("allowed")
    open_ = first.where("status is null").drop("status")
    keys = _sent(open_, send, send_ordered)
    failed = token_bucket(open_.join(keys, "key", "left_semi"), lane, ts, retries, *order)
    failed = failed.withColumn("status", F.when(F.col("allowed"), "failed").otherwise("dropped")).drop("allowed")
    parts = [
        rows.where("kind not in ('malformed', 'ready')").withColumn("status", F.col("kind")),
        first.where("status is not null"),
        open_.join(keys, "key", "left_anti").withColumn("status", F.lit("published")),
        failed,
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def summary(statuses: DataFrame) -> DataFrame:
    """One row of counts by status."""
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return statuses.agg(*(n(s) for s in ("published", "failed", "skipped", "malformed", "throttled", "dropped", "ignored")))


def failures(statuses: DataFrame) -> DataFrame:
    """item_id of the records that the source should deliver again."""
    return statuses.where("status in ('failed', 'throttled')").select("item_id")


def stream(spark: SparkSession, changes: DataFrame, source: str, checkpoint: str, sink: Callable[[DataFrame, int], None], **trigger):
    """A query that prepares each micro-batch of a streaming ``changes`` and hands it to ``sink(prepared rows, batch id)``."""
    return changes.writeStream.foreachBatch(lambda df, n: sink(prepared(df, source), n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
