"""Row types of the log and of the tables derived from it."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(ddl: str) -> T.StructType:
    """A struct from plain "name type" pairs, without a running session."""
    kinds = {
        "string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
        "timestamp": T.TimestampType(), "double": T.DoubleType(), "binary": T.BinaryType()
    }
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in ddl.split(","))])


ORIGIN = _fields("source string, endpoint string")
METADATA = T.StructType(
    [
        T.StructField("command_id", T.StringType()),
        T.StructField("trace", T.MapType(T.StringType(), T.StringType())),
        T.StructField("origin", ORIGIN),
        T.StructField("address", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
#: Metadata as it stands in JSON; the keys are a fixed format.
METADATA_JSON = T.StructType(
    [
        T.StructField("commandId", T.StringType()),
        T.StructField("trace", T.MapType(T.StringType(), T.StringType())),
        T.StructField("origin", ORIGIN),
        T.StructField("address", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("timestamp", T.StringType()),
    ]
)
EVENT = T.StructType(
    [
        *_fields("entity_id string, sequence bigint, event_id string, type string, version bigint, entity_type string, payload string"),
        T.StructField("metadata", METADATA),
        *_fields("commit_id string, created_at timestamp, ttl bigint"),
    ]
)
SNAPSHOT = _fields(
    "entity_id string, entity_type string, sequence bigint, event_sequence bigint, payload string, updated_at timestamp, ttl bigint"
)
VIEW = _fields("pk string, sk string, entity_id string, entity_type string, payload string, ttl bigint")
HEAD = _fields("entity_id string, entity_type string, head_seq bigint")
PROCESSED = _fields("projector string, event_id string")
CHECKPOINT = _fields("entity_id string, checkpoint bigint")
TABLES = {"events": EVENT, "snapshots": SNAPSHOT, "views": VIEW, "heads": HEAD, "processed": PROCESSED, "checkpoints": CHECKPOINT}
KEYS = {
    "events": ["entity_id", "sequence"], "snapshots": ["entity_id"], "views": ["pk", "sk"], "heads": ["entity_id"],
    "processed": ["projector", "event_id"], "checkpoints": ["entity_id"]
}
#: A row of the single-table layout, where a snapshot lies inline at sk 0.
ITEM = _fields(
    "pk string, sk bigint, type string, version bigint, entityType string, payload string, metadata string, ttl bigint, seq bigint, eventSeq bigint"
)
#: A change record of the stream.
CHANGE = T.StructType([*_fields("event_id string, event_name string, sequence_number string"), T.StructField("new_image", ITEM)])
