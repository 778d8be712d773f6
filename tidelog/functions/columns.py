"""Column functions: keys, JSON, base64, times, metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The sort key of a view that names none.
DEFAULT_SK = "VIEW"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dealt(rows: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """Rows dealt out by key and sorted by it and ``order``: all rows of a key in one partition. The shuffle is by a hash of the key: one
    by the key itself Spark leaves out where the rows seem to be dealt by it already, and then puts the partitions of a union's sides
    together side by side, each by its own sizes, or splits those of a skewed join."""
    return rows.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)


def event_id(entity_id: Column | str = "entity_id", sequence: Column | str = "sequence") -> Column:
    return F.concat(col(entity_id), F.lit(":"), col(sequence).cast("string"))


def view_pk(entity_type: Column | str = "entity_type", entity_id: Column | str = "entity_id") -> Column:
    return F.concat(col(entity_type), F.lit("#"), col(entity_id))


def to_json(c: Column) -> Column:
    """JSON with null fields written as null, as the log's payloads have them."""
    return F.to_json(c, {"ignoreNullFields": "false"})


def b64(c: Column) -> Column:
    """Base64 on one line (the built-in function folds lines at 76 characters)."""
    return F.regexp_replace(F.base64(c), "[\r\n]", "")


def b64url(c: Column) -> Column:
    return F.translate(b64(c), "+/", "-_")


def unb64url(c: Column) -> Column:
    return F.unbase64(F.translate(c, "-_", "+/"))


def is_json(c: Column) -> Column:
    """True if the text is valid JSON; null counts as invalid."""
    return F.coalesce(F.try_parse_json(c).isNotNull(), F.lit(False))


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def unix_seconds(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def slug(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def metadata(
    region: Column | None = None, timestamp: Column | None = None, command_id: Column | None = None, trace: Column | None = None, source: Column | None = None, endpoint: Column | None = None, address: Column | None = None
) -> Column:
    """Metadata struct; an empty address is none, the timestamp is RFC 3339 in UTC (now if not given)."""
    text = lambda c: F.lit(None).cast("string") if c is None else c.cast("string")
    origin = F.struct(text(source).alias("source"), text(endpoint).alias("endpoint"))
    return F.struct(
        text(command_id).alias("command_id"),
        (F.lit(None) if trace is None else trace).cast("map<string,string>").alias("trace"),
        (F.when(F.lit(source is not None or endpoint is not None), origin)).alias("origin"),
        F.when(~blank(text(address)), text(address)).alias("address"),
        F.coalesce(text(region), F.lit("")).alias("region"),
        rfc3339(F.current_timestamp() if timestamp is None else timestamp).alias("timestamp"),
    )


def metadata_from_json(c: Column) -> Column:
    """Struct of METADATA from its JSON; unreadable JSON gives a null struct."""
    from .schemas import METADATA_JSON

    m = F.from_json(c, METADATA_JSON)
    made = F.struct(
        m["commandId"].alias("command_id"), m["trace"].alias("trace"), m["origin"].alias("origin"), m["address"].alias("address"),
        m["region"].alias("region"), m["timestamp"].alias("timestamp")
    )
    return F.when(is_json(c), made)


def metadata_to_json(m: Column) -> Column:
    return to_json(F.struct(
        m["command_id"].alias("commandId"), m["trace"].alias("trace"), m["origin"].alias("origin"), m["address"].alias("address"),
        m["region"].alias("region"), m["timestamp"].alias("timestamp")
    ))
