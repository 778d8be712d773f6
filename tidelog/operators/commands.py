"""Commands: serialising new events, command dedupe, and handling commands against folded state."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions.errors import DuplicateCommand
from .fold import tail


def serialize(results: DataFrame) -> DataFrame:
    """Rows of the log from commits (entity_id, entity_type, cur, commit_id, metadata, events array<struct<type, version,
    payload>>): sequences go on from cur, all events of a commit share its metadata."""
    rows = results.select("entity_id", "entity_type", "cur", "commit_id", "metadata", F.posexplode("events").alias("pos", "e"))
    seq = (F.col("cur") + F.col("pos") + 1).cast("long")
    return rows.select(
        "entity_id", seq.alias("sequence"), C.event_id(F.col("entity_id"), seq).alias("event_id"), F.col("e.type").alias("type"),
        F.col("e.version").cast("long").alias("version"), "entity_type", F.col("e.payload").alias("payload"), "metadata", "commit_id"
    )


def seen_commands(log: DataFrame, snapshots: DataFrame | None, scope: str = "since_snapshot", command_id: str = "command_id") -> DataFrame:
    """entity_id, command_id that count as handled: of the events after the entity's snapshot, or of all with scope="all"."""
    events = log if scope == "all" or snapshots is None else tail(log, snapshots)
    return events.where(F.col(command_id).isNotNull() & (F.col(command_id) != "")).select(
        "entity_id", F.col(command_id).alias("command_id")
    ).distinct()


def fresh_commands(commands: DataFrame, seen: DataFrame) -> DataFrame:
    """Commands that were not handled before; those without an id always pass. A command is one row however many events it makes."""
    return commands.join(seen, ["entity_id", "command_id"], "left_anti")


def sort_by_command(events: DataFrame, command_id: Column, event_id: Column, *within: str) -> DataFrame:
    """Adds rank (from 1) within the columns ``within``: by command id where events have one, after them by event id as text. Only
    lists in which all or none have a command id have an order in the log's own terms."""
    order = Window.partitionBy(*within).orderBy(command_id.isNull(), command_id, event_id)
    return events.withColumn("rank", F.row_number().over(order).cast("long"))


def execute(
    log: DataFrame,
    commands: DataFrame,
    start: Callable[[str], dict],
    apply: Callable[[dict, dict], dict],
    handle: Callable[[dict, dict], list[dict]],
    seeds: DataFrame | None = None,
) -> DataFrame:
    """Handles commands (entity_id, command_id, name, body, arrival) in order of arrival, entity by entity: load, dedupe, decide,
    apply, number. ``handle(state, command)`` returns events ({"type", "payload"}) or raises; its events are applied before the
    next command of that entity. ``seeds``: entity_id, event_sequence, state (JSON).

    One row for each command: entity_id, command_id, arrival, status (accepted, duplicate, rejected), error, events (array of
    sequence, type, payload). Only events and seeds of entities that have commands are read on. Entities are dealt out by a shuffle and
    read in order; one state is held at a time.
    """
    mine = commands.select("entity_id").distinct()
    log = log.join(mine, "entity_id", "left_semi")
    seeds = None if seeds is None else seeds.join(mine, "entity_id", "left_semi")
    events = log if seeds is None else tail(log, seeds)
    kind = lambda n: F.lit(n).alias("kind")
    null = lambda t: F.lit(None).cast(t)
    rows = events.select(
        "entity_id", kind(1), F.col("sequence").alias("at"), F.col("type").alias("name"), F.col("payload").alias("body"),
        F.col("command_id")
    )
    rows = rows.unionByName(commands.select("entity_id", kind(2), F.col("arrival").cast("long").alias("at"), "name", "body", "command_id"))
    if seeds is not None:
        rows = rows.unionByName(seeds.select(
            "entity_id", kind(0), F.col("event_sequence").alias("at"), null("string").alias("name"), F.col("state").alias("body"),
            null("string").alias("command_id")
        ))
    columns = ["entity_id", "command_id", "arrival", "status", "error", "events"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, state, seq, seen = None, None, 0, set()
        for frame in frames:
            out = []
            for entity, kind, at, name, body, command in frame[[
                "entity_id", "kind", "at", "name", "body", "command_id"
            ]].itertuples(index=False):
                if entity != own:
                    own, state, seq, seen = entity, start(entity), 0, set()
                if kind == 0:
                    state, seq = json.loads(body), at
                elif kind == 1:
                    state, seq = apply(state, {"type": name, "payload": body}), at
                    if command:
                        seen.add(command)
                else:
                    status, error, made = "accepted", None, []
                    try:
                        if command and command in seen:
                            raise DuplicateCommand(command)
                        new, later = handle(state, {"name": name, "body": body}), state
                        for e in new:
                            later = apply(later, e)
                        state = later
                        made = [{"sequence": seq + i + 1, "type": e["type"], "payload": e.get("payload")} for i, e in enumerate(new)]
                        seq += len(new)
                        if command and new:
                            seen.add(command)
                    except DuplicateCommand as e:
                        status, error = "duplicate", str(e)
                    except Exception as e:  # noqa: BLE001
                        status, error = "rejected", f"{type(e).__name__}: {e}"
                    out.append((entity, command, at, status, error, made))
            yield pd.DataFrame(out, columns=columns)

    ordered = C.dealt(rows, "entity_id", "kind", "at")
    return ordered.mapInPandas(
        run,
        "entity_id string, command_id string, arrival bigint, status string, error string, events array<struct<sequence:bigint,type:string,payload:string>>"
    )
