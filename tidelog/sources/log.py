"""Reads of the event log: scans, point reads, enumeration, and decoding of the layouts that events arrive in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import schemas as S


def scan(log: DataFrame, entity_type: str | None = None) -> DataFrame:
    """All events, or those of one entity type (a row filter, pushed to the files); null or empty matches all."""
    return log.where(F.col("entity_type") == entity_type) if entity_type else log


def scan_where(log: DataFrame, predicate: Column | str, *columns: str) -> DataFrame:
    """Events by any predicate, with only ``columns`` read."""
    found = log.where(predicate)
    return found.select(*columns) if columns else found


def events_of(log: DataFrame, entity_id: str) -> DataFrame:
    """An entity's events in order; none for an unknown entity."""
    return log.where(F.col("entity_id") == entity_id).orderBy("sequence")


def latest_events(log: DataFrame, entity_id: str, after: int) -> DataFrame:
    """An entity's events with a sequence over ``after``, in order."""
    return log.where((F.col("entity_id") == entity_id) & (F.col("sequence") > after)).orderBy("sequence")


def max_sequence(log: DataFrame, entity_id: str) -> DataFrame:
    """One row, max_sequence: the entity's last sequence in the log, 0 if it has none; snapshots don't count."""
    return log.where(F.col("entity_id") == entity_id).agg(F.coalesce(F.max("sequence"), F.lit(0)).cast("long").alias("max_sequence"))


def entity_ids(log: DataFrame, snapshots: DataFrame, entity_type: str | None = None) -> DataFrame:
    """Distinct ids of entities that have events or a snapshot. Each side is made distinct before they meet."""
    sides = [scan(t, entity_type).select("entity_id").distinct() for t in (log, snapshots)]
    return sides[0].union(sides[1]).distinct()


def snapshot_of(snapshots: DataFrame, entity_id: str) -> DataFrame:
    return snapshots.where(F.col("entity_id") == entity_id)


def registered(log: DataFrame, heads: DataFrame, skip: DataFrame | None = None) -> DataFrame:
    """Events of the entities that a registry (heads) lists, without those in ``skip``; pruned before the events are read on."""
    ids = heads.select("entity_id").distinct()
    if skip is not None:
        ids = ids.join(skip.select("entity_id"), "entity_id", "left_anti")
    return log.join(ids, "entity_id", "left_semi")


def decode_items(items: DataFrame, strict: bool = True) -> DataFrame:
    """Events of the single-table layout; inline snapshots (sk 0) are dropped. Unreadable metadata stops a strict scan."""
    good = items.where("sk > 0")
    meta = C.metadata_from_json(F.col("metadata"))
    if strict:
        meta = F.when(C.is_json(F.col("metadata")), meta).otherwise(F.raise_error(F.concat(
            F.lit("unreadable metadata: "), F.coalesce("metadata", F.lit("null"))
        )).cast(S.METADATA))
    return good.select(
        F.col("pk").alias("entity_id"), F.col("sk").alias("sequence"), C.event_id("pk", "sk").alias("event_id"), "type", "version", F.col("entityType").alias("entity_type"), "payload", meta.alias("metadata"), F.lit(None).cast("string").alias("commit_id"), F.lit(None).cast("timestamp").alias("created_at"), "ttl"
    )


def decode_inline_snapshots(items: DataFrame) -> DataFrame:
    """The snapshots that lie inline at sk 0."""
    return items.where("sk = 0").select(
        F.col("pk").alias("entity_id"), F.col("entityType").alias("entity_type"), F.col("seq").alias("sequence"),
        F.col("eventSeq").alias("event_sequence"), "payload", F.lit(None).cast("timestamp").alias("updated_at"), "ttl"
    )


#: The type tags of an attribute.
TAGS = ("S", "N", "B", "BOOL", "NULL", "L", "M", "SS", "NS", "BS")


def typed_attributes(c: Column, schema: str | T.StructType) -> Column:
    """Fields of a typed attribute map ({"pk": {"S": "a"}, "sk": {"N": "1"}}) by a declared schema such as "pk string, sk bigint": strings
    from S, numbers from N (decimal text), booleans from BOOL, binaries from B (base64), arrays from SS, NS, BS or L, structs
    from M, nested at will. NULL, and an attribute that isn't there, is null. An attribute with a tag that is none of TAGS, or
    with one that doesn't fit its field, stops the query."""
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return F.struct(*(_attribute(F.get_json_object(c, f"$['{f.name}']"), f.dataType, f.name).alias(f.name) for f in kind.fields))


def _attribute(value: Column, kind: T.DataType, name: str) -> Column:
    """One typed value (JSON text such as {"N": "1"}) as a column of the type."""
    tag = F.get(F.json_object_keys(value), F.lit(0))
    inner = lambda t: F.get_json_object(value, f"$.{t}")
    if isinstance(kind, T.StructType):
        fits = {"M": typed_attributes(inner("M"), kind)}
    elif isinstance(kind, T.ArrayType):
        of = kind.elementType
        texts = lambda t: F.from_json(inner(t), "array<string>")
        fits = {"L": F.transform(texts("L"), lambda x: _attribute(x, of, name))}
        if isinstance(of, T.StringType):
            fits["SS"] = texts("SS")
        elif isinstance(of, T.BinaryType):
            fits["BS"] = F.transform(texts("BS"), F.unbase64)
        elif isinstance(of, T.NumericType):
            fits["NS"] = F.transform(texts("NS"), lambda x: x.cast(of))
    elif isinstance(kind, T.StringType):
        fits = {"S": inner("S")}
    elif isinstance(kind, T.BooleanType):
        fits = {"BOOL": inner("BOOL").cast("boolean")}
    elif isinstance(kind, T.BinaryType):
        fits = {"B": F.unbase64(inner("B"))}
    elif isinstance(kind, T.NumericType):
        fits = {"N": inner("N").cast(kind)}
    else:
        raise ValueError(f"no attribute has the type {kind.simpleString()}: {name}")
    null = F.lit(None).cast(kind)
    out = F.when(value.isNull() | (tag == "NULL"), null)
    for t, column in fits.items():
        out = out.when(tag == t, column)
    what = F.when(
        tag.isin(*TAGS), F.lit(f"attribute {name} is no {kind.simpleString()}: ")
    ).otherwise(F.lit(f"attribute {name} has an unknown type: "))
    return out.otherwise(F.raise_error(F.concat(what, F.coalesce(tag, F.lit("none")))).cast(kind))


def normalize_notifications(raw: DataFrame, body: str = "raw") -> DataFrame:
    """Messages of a raw transport event: (source, message_id, message, error). The first record tells topic or queue; anything
    else is an error row."""
    records = F.from_json(F.get_json_object(F.col(body), "$.Records"), "array<string>")
    first = F.get(records, F.lit(0))
    found = raw.select(
        records.alias("records"),
        F.coalesce(F.get_json_object(first, "$.EventSource"), F.get_json_object(first, "$.eventSource")).alias("source")
    )
    known = F.coalesce(F.col("source").isin("aws:sns", "aws:sqs"), F.lit(False))
    null = F.lit(None).cast("string")
    bad = found.where(~known).select(
        "source", null.alias("message_id"), null.alias("message"), F.lit("unsupported event source").alias("error")
    )
    good = found.where(known).select("source", F.explode("records").alias("r"))
    pick = lambda topic, queue: F.when(
        F.col("source") == "aws:sns", F.get_json_object("r", topic)
    ).otherwise(F.get_json_object("r", queue))
    return good.select(
        "source", pick("$.Sns.MessageId", "$.messageId").alias("message_id"), pick("$.Sns.Message", "$.body").alias("message"),
        null.alias("error")
    ).unionByName(bad)


def decode_envelopes(messages: DataFrame, body: str = "message") -> DataFrame:
    """Adds (or replaces) the event fields of an envelope and ``reject``: null if the message is usable, else why not. The payload on the wire
    is base64."""
    event = "struct<id:string,sequence:bigint,type:string,version:bigint,entityId:string,entityType:string,payload:string,metadata:string>"
    env = F.from_json(F.col(body), "struct<id:string,source:string,`detail-type`:string,detail:string>")
    out = messages.withColumn("__detail", F.when(C.is_json(F.col(body)), env["detail"])).withColumn(
        "__event", F.when(C.is_json(F.col("__detail")), F.from_json("__detail", event))
    )
    reject = (
        F.when(~C.is_json(F.col(body)), "envelope is not JSON")
        .when(F.col("__event").isNull(), "detail is not an event")
        .when(F.coalesce(F.col("__event.entityId"), F.lit("")) == "", "event envelope has no entity id")
        .when(F.coalesce(F.col("__event.id"), F.lit("")) == "", "event envelope has no event id")
    )
    e = lambda n: F.col(f"__event.{n}")
    made = {"event_id", "entity_id", "entity_type", "type", "sequence", "version", "payload", "metadata_json", "reject"}
    return out.select(
        *(c for c in messages.columns if c not in made), e("id").alias("event_id"), e("entityId").alias("entity_id"),
        e("entityType").alias("entity_type"), e("type").alias("type"), e("sequence").alias("sequence"), e("version").alias("version"),
        F.unbase64(e("payload")).cast("string").alias("payload"), e("metadata").alias("metadata_json"), reject.alias("reject")
    )


def change_records(changes: DataFrame, id_from: str = "key") -> DataFrame:
    """Usable inserts of a change stream: event_name INSERT, an image, an event (not an inline snapshot), and pk, sk and type.
    event_id is entity:sequence, or the stream record's id with id_from="record"."""
    image = F.col("new_image")
    good = changes.where("event_name = 'INSERT'").where(
        image.isNotNull() & image["pk"].isNotNull() & (image["sk"] > 0) & image["type"].isNotNull()
    )
    key = C.event_id(image["pk"], image["sk"]) if id_from == "key" else F.col("event_id")
    return good.select(
        key.alias("event_id"), image["pk"].alias("entity_id"), image["sk"].alias("sequence"), image["type"].alias("type"),
        image["version"].alias("version"), image["entityType"].alias("entity_type"), image["payload"].alias("payload"),
        image["metadata"].alias("metadata_json")
    )
