"""Folding ordered events into entity state, three ways.

``fold``: state fields given as reducers; partial and final aggregates, no event list, seeds merge as one more operand.
``fold_ordered``: state machines whose step depends on order, as an expression over the entity's sorted events; memory is one
entity's events. ``fold_python``: any Python step over rows sorted within partitions; one state in memory at a time, however
long an entity's stream is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

ID, SEQ = "entity_id", "sequence"


@dataclass(frozen=True)
class Reducer:
    """How a state field follows from events. kind: sum, count, min, max or last; value: of an event; when: the events that
    touch the field (all if none). last takes the value of the last such event even if it is null."""

    kind: str
    value: Column | None = None
    when: Column | None = None

    def aggregate(self) -> Column:
        when = F.lit(True) if self.when is None else self.when
        if self.kind == "count":
            return F.count(F.when(when, 1))
        if self.kind == "last":
            # a struct, so that a null value replaces an older one
            return F.max_by(F.when(when, F.struct(self.value.alias("v"))), F.when(when, F.col(SEQ)))
        return getattr(F, self.kind)(F.when(when, self.value))

    def finish(self, new: Column) -> Column:
        if self.kind in ("sum", "count"):
            return F.coalesce(new, F.lit(0))
        return new["v"] if self.kind == "last" else new

    def merge(self, seed: Column, new: Column) -> Column:
        """State from a seed and the aggregate of the events after it."""
        if self.kind in ("sum", "count"):
            return F.coalesce(seed, F.lit(0)) + F.coalesce(new, F.lit(0))
        if self.kind == "last":
            return F.when(new.isNotNull(), new["v"]).otherwise(seed)
        return F.least(seed, new) if self.kind == "min" else F.greatest(seed, new)


def fold(log: DataFrame, fields: dict[str, Reducer]) -> DataFrame:
    """entity_id, head_seq and the state fields of each entity with events."""
    aggs = [r.aggregate().alias(n) for n, r in fields.items()]
    folded = log.groupBy(ID).agg(F.max(SEQ).alias("head_seq"), *aggs)
    return folded.select(ID, "head_seq", *(r.finish(F.col(n)).alias(n) for n, r in fields.items()))


def running(log: DataFrame, fields: dict[str, Reducer]) -> DataFrame:
    """entity_id, sequence and the state fields after each event. One window: an entity's events are sorted in one task."""
    w = Window.partitionBy(ID).orderBy(SEQ).rowsBetween(Window.unboundedPreceding, 0)
    return log.select(ID, SEQ, *(r.finish(r.aggregate().over(w)).alias(n) for n, r in fields.items()))


def tail(log: DataFrame, seeds: DataFrame) -> DataFrame:
    """Events after their entity's snapshot (entity_id, event_sequence); all events of entities without one."""
    floors = seeds.select(F.col(ID), F.col("event_sequence").alias("__floor"))
    return log.join(floors, ID, "left").where(F.col(SEQ) > F.coalesce("__floor", F.lit(0))).drop("__floor")


def fold_seeded(log: DataFrame, seeds: DataFrame, fields: dict[str, Reducer]) -> DataFrame:
    """As ``fold``, from snapshots: seeds has entity_id, event_sequence and the state fields. Entities that have only a snapshot
    or only events are kept. After a compaction this is the correct fold."""
    aggs = [r.aggregate().alias(f"__{n}") for n, r in fields.items()]
    new = tail(log, seeds).groupBy(ID).agg(F.max(SEQ).alias("__head"), *aggs)
    both = seeds.select(ID, "event_sequence", *fields).join(new, ID, "full")
    head = F.greatest(F.coalesce("__head", F.lit(0)), F.coalesce("event_sequence", F.lit(0)))
    state = [
        F.when(F.col("event_sequence").isNull(), r.finish(F.col(f"__{n}"))).otherwise(r.merge(F.col(n), F.col(f"__{n}"))).alias(n) for n,
        r in fields.items()
    ]
    return both.select(ID, head.alias("head_seq"), *state)


def fold_ordered(
    log: DataFrame, columns: list[str], start: Column, step: Callable[[Column, Column], Column],
    finish: Callable[[Column], Column] | None = None, seeds: DataFrame | None = None
) -> DataFrame:
    """entity_id, head_seq, state: ``step(state, event)`` over the entity's events in order, from ``start`` or from the state
    column of seeds (entity_id, event_sequence, state)."""
    events = tail(log, seeds) if seeds is not None else log
    listed = events.groupBy(ID).agg(F.max(SEQ).alias("head_seq"), F.sort_array(F.collect_list(F.struct(SEQ, *columns))).alias("__events"))
    begin = start
    if seeds is not None:
        listed = listed.join(seeds.select(ID, "event_sequence", F.col("state").alias("__seed")), ID, "full")
        listed = listed.withColumn(
            "head_seq", F.greatest(F.coalesce("head_seq", F.lit(0)), F.coalesce("event_sequence", F.lit(0)))
        ).withColumn("__events", F.coalesce("__events", F.array()))
        begin = F.coalesce("__seed", start)
    return listed.select(ID, "head_seq", F.aggregate("__events", begin, step, finish or (lambda s: s)).alias("state"))


def fold_python(
    log: DataFrame, columns: list[str], start: Callable[[str], dict], apply: Callable[[dict, dict], dict | None], schema: str
) -> DataFrame:
    """entity_id, head_seq, the state fields of ``schema`` and error for each entity. ``apply(state, event)`` returns the new
    state; an exception ends that entity's fold, which is given with its error and state so far; others go on. An entity whose
    state is None at the end is not given."""
    names = [x.split()[0].strip("`") for x in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state, head, error = None, None, 0, None

        def row() -> list:
            return [] if own is None or (state is None and error is None) else [{
                ID: own, "head_seq": head, "error": error, **{n: (state or {}).get(n) for n in names}
            }]

        for frame in frames:
            out: list = []
            for event in frame.to_dict("records"):
                if event[ID] != own:
                    out += row()
                    own, head, error = event[ID], 0, None
                    state = start(own)
                if error is None:
                    try:
                        state = apply(state, event)
                        head = event[SEQ]
                    except Exception as e:  # noqa: BLE001
                        error = f"{type(e).__name__}: {e}"
            yield pd.DataFrame(out, columns=[ID, "head_seq", *names, "error"])
        yield pd.DataFrame(row(), columns=[ID, "head_seq", *names, "error"])

    ordered = C.dealt(log.select(ID, SEQ, *columns), ID, SEQ)
    return ordered.mapInPandas(run, f"{ID} string, head_seq bigint, {schema}, error string")
