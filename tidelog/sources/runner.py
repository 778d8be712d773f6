"""Running commands against a store: load, dedupe, decide, apply, project, commit."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import commands as CMD
from ..operators import snapshots
from .store import Store


class CommandRunner:
    """Handles batches of commands of one entity type.

    start, apply, handle: as for ``operators.commands.execute``. every: snapshot interval. project: turns states (entity_id,
    entity_type, head_seq, state as JSON) into views that are published with the events. States are read from snapshots and the
    events after them. A batch is one commit: if another writer took a sequence, all of it is a Conflict and may be run again.
    """

    def __init__(
        self, store: Store, entity_type: str, start: Callable, apply: Callable, handle: Callable, every: int = 5,
        project: Callable[[DataFrame], DataFrame] | None = None
    ):
        self.store, self.entity_type, self.start, self.apply, self.handle, self.every, self.project = store, entity_type, start, apply, handle, every, project

    def _log(self, at: int) -> DataFrame:
        log = self.store.read("events", at).where(F.col("entity_type") == self.entity_type)
        return log.withColumn("command_id", F.col("metadata.command_id"))

    def run(self, commands: DataFrame) -> DataFrame:
        """One row for each command (entity_id, command_id, arrival, status, error, events); accepted ones are committed."""
        store, spark = self.store, self.store.spark
        at = store.version()
        mine = commands.select("entity_id").distinct()
        log = self._log(at).join(mine, "entity_id", "left_semi")
        snaps = store.read("snapshots", at).where(F.col("entity_type") == self.entity_type).join(mine, "entity_id", "left_semi")
        seeds = snaps.select("entity_id", "event_sequence", F.col("payload").alias("state"))
        folder = f"{store.path}/decided/{uuid.uuid4().hex}"
        CMD.execute(log, commands, self.start, self.apply, self.handle, seeds).write.parquet(folder)
        done = spark.read.parquet(folder)
        made = done.where("status = 'accepted'").select("entity_id", "command_id", "arrival", F.explode("events").alias("e"))
        events = made.select(
            "entity_id", F.col("e.sequence").alias("sequence"), C.event_id(
                F.col("entity_id"), F.col("e.sequence")
            ).alias("event_id"), F.col("e.type").alias("type"), F.lit(1).cast("long").alias("version"), F.lit(self.entity_type).alias("entity_type"), F.col("e.payload").alias("payload"),
            C.metadata(command_id=F.col("command_id")).alias("metadata"), F.concat_ws(
                ":", "entity_id", F.col("arrival").cast("string")
            ).alias("commit_id"), F.current_timestamp().alias("created_at"),
        )
        if events.isEmpty():
            return done
        states = self.states(log.drop("command_id").unionByName(events, allowMissingColumns=True), seeds)
        due = snapshots.floors(events, self.every).select(
            "entity_id", F.col("event_sequence").alias("due"), F.col("sequence").alias("more")
        )
        old = snaps.select("entity_id", F.col("sequence").alias("n"))
        # a snapshot holds the state after the batch, so it covers the batch's last event
        taken = states.join(due, "entity_id").join(old, "entity_id", "left").select(
            "entity_id", "entity_type", (F.coalesce("n", F.lit(0)) + F.col("more")).alias("sequence"),
            F.col("head_seq").alias("event_sequence"), F.col("state").alias("payload"), F.current_timestamp().alias("updated_at")
        )
        store.commit(events, None if taken.isEmpty() else taken, self.project(states) if self.project else None)
        return done

    def states(self, log: DataFrame, seeds: DataFrame) -> DataFrame:
        """entity_id, entity_type, head_seq, state (JSON) from snapshots and the events after them."""
        from ..operators.fold import fold_python, tail

        begin = seeds.select(
            "entity_id", F.col("event_sequence").alias("sequence"), F.lit(None).cast("string").alias("type"),
            F.col("state").alias("payload")
        )
        rows = begin.unionByName(tail(log, seeds).select("entity_id", "sequence", "type", "payload"))
        start, apply = self.start, self.apply

        def step(state, event):
            if event["type"] is None:
                return {"state": event["payload"]}
            now = json.loads(state["state"]) if state["state"] is not None else start(event["entity_id"])
            return {"state": json.dumps(apply(now, {"type": event["type"], "payload": event["payload"]}))}

        folded = fold_python(rows, ["type", "payload"], lambda _: {"state": None}, step, "state string")
        return folded.where("error is null").select("entity_id", F.lit(self.entity_type).alias("entity_type"), "head_seq", "state")
