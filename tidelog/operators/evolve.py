"""Schema evolution and decoding of payloads."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.schemas import METADATA


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)``, the value computed once a row however often ``f`` uses it: plans stay linear in the length of a chain."""
    return F.transform(F.array(value), f)[0]


@dataclass(frozen=True)
class Upcaster:
    """Turns events of (type, version) into a newer form; null version matches all. payload gives the new JSON payload, null if
    the event cannot be upcast."""

    type: str
    version: int
    payload: Callable[[Column], Column]
    to_version: int
    to_type: str | None = None


def upcast(log: DataFrame, chain: list[Upcaster]) -> DataFrame:
    """One pass over the upcasters in their order, each tested against what the former left. Adds failed_phase (upcast if one
    failed; that event's later upcasters don't run)."""
    none = F.lit(None).cast("string")
    state = F.struct(
        F.col("type").alias("type"), F.col("version").cast("long").alias("version"), F.col("payload").alias("payload"), none.alias("phase")
    )

    def step(u: Upcaster) -> Callable[[Column], Column]:
        def done(s: Column, made: Column) -> Column:
            new = F.struct(
                F.lit(u.to_type or u.type).alias("type"), F.lit(u.to_version).cast("long").alias("version"), made.alias("payload"),
                none.alias("phase")
            )
            return F.when(made.isNotNull(), new).otherwise(F.struct(
                s["type"].alias("type"), s["version"].alias("version"), s["payload"].alias("payload"), F.lit("upcast").alias("phase")
            ))

        def one(s: Column) -> Column:
            hit = (s["type"] == u.type) & (s["version"] == u.version) & s["phase"].isNull()
            return F.when(hit, _let(u.payload(s["payload"]), lambda made: done(s, made))).otherwise(s)

        return one

    for u in chain:
        state = _let(state, step(u))
    out = log.withColumn("__u", state)
    names = {"type": "type", "version": "version", "payload": "payload", "failed_phase": "phase"}
    return out.select(*(F.col(f"__u.{names[c]}").alias(c) if c in names else F.col(c) for c in [
        *log.columns, *(["failed_phase"] if "failed_phase" not in log.columns else [])
    ]))


def strict_decode(log: DataFrame, schemas: dict[str, str], fail: bool = False) -> DataFrame:
    """Adds ``data`` (a struct with a field for each known type, set for the event's own) and ``error``: null, or a struct (type,
    version, phase). Unknown types, bad JSON and values that don't fit the schema fail in phase deserialize; what upcast left as
    failed fails in phase upcast. With ``fail``, a failure stops the query."""
    failed = F.col("failed_phase") if "failed_phase" in log.columns else F.lit(None).cast("string")
    # types of one schema are parsed by one expression; projections one after another bind what is used more than once
    types: dict[str, list[str]] = {}
    for t, schema in schemas.items():
        types.setdefault(schema, []).append(t)
    parsed = [
        F.when(
            F.col("type").isin(*own),
            F.from_json("payload", f"{schema}, __bad string", {"columnNameOfCorruptRecord": "__bad", "mode": "PERMISSIVE"})
        ).alias(f"s{i}") for i,
        (schema, own) in enumerate(types.items())
    ]
    at = {t: F.col("__parsed")[f"s{i}"] for i, own in enumerate(types.values()) for t in own}
    fits = F.coalesce(
        *(F.when(F.col("type").isin(*own), at[own[0]].isNotNull() & at[own[0]]["__bad"].isNull()) for own in types.values()), F.lit(False)
    )
    out = log.withColumn("__parsed", F.struct(*parsed)).withColumn("__fits", fits)
    out = out.withColumn("__phase", F.when(failed.isNotNull(), failed).when(~F.col("__fits"), "deserialize"))
    error = F.struct(F.col("type").alias("type"), F.col("version").alias("version"), F.col("__phase").alias("phase"))
    if fail:
        text = F.concat_ws(" ", F.lit("replay failed closed:"), "type", F.col("version").cast("string"), "__phase")
        error = F.raise_error(text).cast("struct<type:string,version:bigint,phase:string>")
    data = F.struct(*(F.when(
        F.col("__fits") & (F.col("type") == t), at[t].dropFields("__bad")
    ).alias(t.replace(".", "_").replace(":", "_")) for t in schemas))
    return out.select(*log.columns, data.alias("data"), F.when(F.col("__phase").isNotNull(), error).alias("error"))


def lenient_decode(records: DataFrame, metadata: str = "metadata_json") -> DataFrame:
    """Stream records for projection: unreadable metadata is empty, a version under 1 is 1."""
    empty = F.lit(None).cast(METADATA)
    return records.withColumns({
        "metadata": F.coalesce(C.metadata_from_json(F.col(metadata)), empty),
        "version": F.when(F.coalesce(F.col("version"), F.lit(0)) <= 0, 1).otherwise(F.col("version")).cast("long")
    })


def invalid_reason(metadata: Column) -> Column:
    """Why a change record is dropped: missing (blank metadata), invalid_json, or null."""
    return F.when(C.blank(metadata), "missing").when(~C.is_json(metadata), "invalid_json")
