"""A transactional store on plain Parquet: immutable folders of files and a log of manifests.

Each version is a manifest that names the live folders and files of every table. A commit writes its folders, then publishes the
next manifest: written whole under another name first, it gets its own by one atomic step that fails if the name is taken. A writer
that dies leaves nothing; who loses that race checks again against the new version and retries. Readers see one manifest, so all
tables of a commit appear together.

Removing events rewrites the files that hold them and no others. Small commits of the log are folded into one folder when FOLD_AT of
them are there.

Keyed tables (views, snapshots, heads, checkpoints) are kept as a base and deltas: an upsert or deletion writes its own rows only,
with their version; a read merges what it finds by key, and every MERGE_AT deltas are folded into a new base. So the cost of a
write follows the write and not the table.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions.errors import Conflict
from ..functions.policy import TRANSIENT, UNKNOWN, Retry
from ..functions.schemas import KEYS, TABLES
from ..operators import heads as H
from ..operators import maintenance, views
from .writes import Transaction

#: Deltas of a table after which a commit folds them, and entities of a commit up to which the log's files are pruned by id.
MERGE_AT, PRUNED = 16, 1000
#: Small commits (under SMALL bytes each) in a row after which the log folds them, in files of about FILE bytes.
FOLD_AT, SMALL, FILE = 64, 32 << 20, 128 << 20
#: File systems that rename atomically and never over an existing file.
RENAMES = frozenset("hdfs viewfs webhdfs abfs abfss".split())
_MERGED = ("views", "snapshots", "heads", "checkpoints")
_HIDDEN = T.StructType([
    T.StructField("__version", T.LongType()), T.StructField("__arrival", T.LongType()), T.StructField("__gone", T.BooleanType())
])
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class Lost(Exception):
    """Another writer made the version first."""


class Store:
    def __init__(self, spark: SparkSession, path: str, tables: dict | None = None, retry: Retry | None = None):
        for name in tables or {}:
            if not _NAME.fullmatch(name):
                raise ValueError(f"invalid table name: {name!r}")
        self.spark, self.path, self.tables = spark, path.rstrip("/"), {**TABLES, **(tables or {})}
        self.retry = retry or Retry(attempts=8, base=0.05, classify=lambda e: TRANSIENT if isinstance(e, Lost) else UNKNOWN)
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def ensure(self) -> Store:
        """Makes the store if it isn't there; may be repeated."""
        if self.version() is None:
            try:
                self._publish(0, {t: [] for t in self.tables})
            except Lost:
                pass
        return self

    def _versions(self) -> list[tuple[int, int]]:
        """(version, bytes) of the manifests; of those under another name none."""
        log = self._path(f"{self.path}/_log")
        if not self._fs.exists(log):
            return []
        found = [(s.getPath().getName(), s.getLen()) for s in self._fs.listStatus(log)]
        return [(int(n.split(".")[0]), size) for n, size in found if n.endswith(".json") and not n.startswith(".")]

    def version(self) -> int | None:
        """The newest version; an empty manifest, which a writer of an older kind may have left, is none."""
        return max((n for n, size in self._versions() if size), default=None)

    def manifest(self, version: int | None = None) -> tuple[int, dict[str, list[str]]]:
        at = self.version() if version is None else version
        if at is None:
            raise FileNotFoundError(f"no store at {self.path}")
        row = self.spark.read.text(f"{self.path}/_log/{at:020d}.json", wholetext=True).first()
        return at, json.loads(row[0])

    def _publish(self, version: int, live: dict[str, list[str]]) -> None:
        """Makes a version; Lost if it is there. Its body is complete before it has its name."""
        log = f"{self.path}/_log"
        target, data = self._path(f"{log}/{version:020d}.json"), bytearray(json.dumps(live).encode())
        kind = self._fs.getUri().getScheme()
        if kind != "file" and kind not in RENAMES:  # object stores show a file when it is closed
            self._written(target, data)
            return
        own = self._path(f"{log}/.{uuid.uuid4().hex}.new")
        self._written(own, data)
        try:
            if kind == "file":
                files, paths = self.spark._jvm.java.nio.file.Files, self.spark._jvm.java.nio.file.Path
                there, here = (paths.of(self._fs.makeQualified(p).toUri()) for p in (target, own))
                self._exclusive(lambda: files.createLink(there, here), version)
            elif not self._exclusive(lambda: self._fs.rename(own, target), version):
                raise Lost(str(version))
        finally:
            self._fs.delete(own, False)

    def _written(self, target, data: bytearray) -> None:
        out = self._exclusive(lambda: self._fs.create(target, False), target.getName())
        out.write(data)
        out.close()

    @staticmethod
    def _exclusive(step: Callable, what: object):
        try:
            return step()
        except Exception as e:  # py4j wraps FileAlreadyExistsException
            if "exist" in str(e).lower():
                raise Lost(str(what)) from e
            raise

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The table as of a version (the newest if not given)."""
        _, live = self.manifest(version)
        return self._live(table, live.get(table, []))

    def _live(self, table: str, folders: list[str]) -> DataFrame:
        schema = self.tables[table]
        if not folders:
            return self.spark.createDataFrame([], schema)
        if table not in _MERGED:
            return self.spark.read.schema(schema).parquet(*folders)
        rows = self.spark.read.schema(T.StructType([*schema.fields, *_HIDDEN.fields])).parquet(*folders)
        return rows.select(*schema.names) if len(folders) == 1 and "/base-" in folders[0] else _merged(table, rows).select(*schema.names)

    def _shaped(self, table: str, rows: DataFrame, *more: str) -> DataFrame:
        """Rows with the table's columns, missing ones null."""
        return rows.select(
            *(F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in self.tables[table]),
            *more
        )

    def _write(self, table: str, rows: DataFrame, at: int = 0, gone: bool = False, base: bool = False) -> str:
        folder = f"{self.path}/data/{table}/{'base-' * base}{uuid.uuid4().hex}"
        hidden = []
        if table in _MERGED:
            arrival = F.col("arrival").cast("long") if "arrival" in rows.columns else F.lit(0).cast("long")
            hidden = [F.lit(at + 1).cast("long").alias("__version"), arrival.alias("__arrival"), F.lit(gone).alias("__gone")]
        rows = self._shaped(table, rows, *hidden)
        # files sorted by key: row groups that a point or tail read does not need are skipped
        rows.sortWithinPartitions(*KEYS.get(table, rows.columns[:1])).write.parquet(folder)
        return folder

    def _put(self, at: int, live: dict, table: str, rows: DataFrame, gone: bool = False) -> dict:
        """``live`` with a delta of the table, folded if there are many."""
        folders = [*live.get(table, []), self._write(table, rows, at, gone)]
        if len(folders) > MERGE_AT:
            folders = [self._write(table, self._live(table, folders), at, base=True)]
        return live | {table: folders}

    def transact(self, change: Callable[[int, dict[str, list[str]]], dict[str, list[str]] | None]) -> int:
        """Publishes ``change(version, live folders)`` (None: nothing to publish); runs it anew on a newer version if another writer came
        first. Returns the version that holds the change."""

        def once() -> int:
            found = self._versions()  # before the manifest: a version that comes after it is a lost race
            at, live = self.manifest(max((n for n, size in found if size), default=None))
            new = change(at, {t: list(f) for t, f in live.items()})
            if new is None:
                return at
            self._publish(max(n for n, _ in found) + 1, new)
            return max(n for n, _ in found) + 1

        try:
            return self.retry.run(once)
        except Exception as e:
            raise getattr(e, "error", e) from None

    # writes

    def conflicts(self, events: DataFrame, version: int | None = None) -> DataFrame:
        """Keys of ``events`` that it holds twice or that the log has."""
        keys, log = events.select("entity_id", "sequence"), self.read("events", version).select("entity_id", "sequence")
        ids = [r[0] for r in keys.select("entity_id").distinct().limit(PRUNED + 1).collect()]
        if len(ids) <= PRUNED:  # files are sorted by id: what a small commit can't meet is not read
            log = log.where(F.col("entity_id").isin(ids))
        twice = keys.groupBy("entity_id", "sequence").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        taken = keys.join(log, ["entity_id", "sequence"], "left_semi")
        return twice.union(taken).distinct()

    def commit(self, events: DataFrame, snapshot: DataFrame | None = None, view_rows: DataFrame | None = None) -> int:
        """Appends events, upserts snapshots and views, all or nothing; any taken (entity_id, sequence) is a Conflict. No events: no
        change. A snapshot needs events."""
        if events.isEmpty():
            if snapshot is not None:
                raise ValueError("a snapshot needs the events of its commit")
            if view_rows is None:
                return self.manifest()[0]
        folder = self._write("events", events)

        def change(at: int, live: dict) -> dict:
            own = self.spark.read.schema(self.tables["events"]).parquet(folder)
            bad = self.conflicts(own, at).limit(20).collect()
            if bad:
                raise Conflict(f"sequence taken: {bad[0].entity_id}:{bad[0].sequence}", [tuple(r) for r in bad])
            live["events"] = self._folded("events", [*live["events"], folder])
            if snapshot is not None:
                live = self._put(at, live, "snapshots", snapshot)
            if view_rows is not None:
                live = self._put(
                    at, live, "views",
                    views.keyed(self._shaped("views", view_rows, *(["arrival"] if "arrival" in view_rows.columns else [])))
                )
            return live

        return self.transact(change)

    def _folded(self, table: str, entries: list[str]) -> list[str]:
        """The entries of a table, the last FOLD_AT of them put together if all are small. Only these are looked at."""
        last = entries[-FOLD_AT:]
        size = [self._fs.getContentSummary(self._path(e)).getLength() for e in last] if len(last) == FOLD_AT else []
        if not size or max(size) >= SMALL:
            return entries
        rows = self.spark.read.schema(self.tables[table]).parquet(*last).repartition(max(1, -(-sum(size) // FILE)), KEYS[table][0])
        return [*entries[:-FOLD_AT], self._write(table, rows)]

    def apply(self, transaction: Transaction, snapshot: DataFrame | None = None) -> int:
        """Publishes all groups of a transaction in one version: events appended (a taken key is a Conflict), other tables put or
        deleted, in order. No groups: no change."""
        groups = [g for g in transaction.by_table().values() if not g.rows.isEmpty()]
        if not groups:
            return self.manifest()[0]
        events = [g for g in groups if g.table == "events"]
        if any(g.mode != "put" for g in events):
            raise PermissionError("events are deleted by delete_events only")
        folders = [self._write("events", g.rows) for g in events]

        def change(at: int, live: dict) -> dict:
            for folder in folders:
                own = self.spark.read.schema(self.tables["events"]).parquet(folder)
                bad = self.conflicts(own, at).limit(20).collect()
                if bad:
                    raise Conflict(f"sequence taken: {bad[0].entity_id}:{bad[0].sequence}", [tuple(r) for r in bad])
                live["events"] = self._folded("events", [*live["events"], folder])
            for g in groups:
                if g.table == "events":
                    continue
                rows = self._shaped(g.table, g.rows, *(["arrival"] if "arrival" in g.rows.columns else []))
                live = self._put(at, live, g.table, views.keyed(rows) if g.table == "views" else rows, gone=g.mode == "delete")
            return live if snapshot is None else self._put(at, live, "snapshots", snapshot)

        return self.transact(change)

    def commit_stream(self, events: DataFrame, arrival: str = "arrival") -> DataFrame:
        """Commits many results (rows of events with commit_id and ``arrival``), each all or nothing and in order of arrival for an
        entity: a rejected one takes no sequence and stops none of the others. If another writer comes first, all are decided again on
        what the log holds then. Returns commit_id, entity_id, accepted."""
        root = f"{self.path}/decided/{uuid.uuid4().hex}"
        events.write.parquet(f"{root}/offered")
        offered = self.spark.read.schema(events.schema).parquet(f"{root}/offered")

        def change(at: int, live: dict) -> dict | None:
            accept(
                offered, self.read("events", at).select("entity_id", "sequence"), arrival
            ).write.mode("overwrite").parquet(f"{root}/decided")
            good = self.spark.read.parquet(f"{root}/decided").where("accepted").select("commit_id", "entity_id")
            if good.isEmpty():
                return None
            folder = self._write("events", offered.join(good, ["commit_id", "entity_id"], "left_semi"))
            return live | {"events": self._folded("events", [*live["events"], folder])}

        self.transact(change)
        return self.spark.read.parquet(f"{root}/decided")

    def _without(
        self, live: dict, table: str, hits: Callable[[DataFrame], DataFrame], kept: Callable[[DataFrame], DataFrame]
    ) -> dict | None:
        """``live`` with the files of the table that hold a row of ``hits`` rewritten to what ``kept`` leaves of them; None if none does."""
        entries, schema = live.get(table, []), self.tables[table]
        if not entries:
            return None
        log = self.spark.read.schema(schema).parquet(*entries)
        found = hits(log.select("*", F.col("_metadata.file_path").alias("__file"))).select("__file").distinct().collect()
        touched = {unquote(urlsplit(r[0]).path) for r in found}
        if not touched:
            return None
        left, old = [], []
        for entry in entries:
            own = self._path(entry)
            files = [s.getPath() for s in self._fs.listStatus(own)] if self._fs.getFileStatus(own).isDirectory() else [own]
            files = [f for f in files if f.getName().endswith(".parquet")]
            gone = [f for f in files if self._plain(f) in touched]
            old += [f.toString() for f in gone]
            left += [entry] if not gone else [f.toString() for f in files if f not in gone]
        rows = kept(self.spark.read.schema(schema).parquet(*old))
        return live | {table: [*left, self._write(table, rows)]}

    def _plain(self, path) -> str:
        return self._fs.resolvePath(path).toUri().getPath()

    def put_snapshots(self, rows: DataFrame) -> int:
        """Upserts snapshots; one that lowers event_sequence changes nothing, an equal one overwrites."""
        return self.transact(lambda at, live: self._put(at, live, "snapshots", rows))

    def put_views(self, rows: DataFrame) -> int:
        """Upserts views; of equal keys the greatest ``arrival`` (if the rows have one) stays."""
        incoming = views.keyed(self._shaped("views", rows, *(["arrival"] if "arrival" in rows.columns else [])))
        return self.transact(lambda at, live: self._put(at, live, "views", incoming))

    def delete_views(self, keys: DataFrame) -> int:
        gone = views.keyed(self._shaped("views", keys))
        return self.transact(lambda at, live: self._put(at, live, "views", gone, gone=True))

    def delete_events(self, keys: DataFrame, unsafe: bool = False) -> int:
        """Removes single events. Not for production: the log is the truth."""
        if not unsafe:
            raise PermissionError("raw deletion needs unsafe=True")
        keys = keys.select("entity_id", "sequence").distinct()
        return self.transact(lambda at, live: self._without(
            live, "events", lambda log: log.join(keys, ["entity_id", "sequence"], "left_semi"),
            lambda log: log.join(keys, ["entity_id", "sequence"], "left_anti")
        ))

    def put_heads(self, rows: DataFrame) -> int:
        return self.transact(lambda at, live: self._put(at, live, "heads", H.merge(rows)))

    def mark_processed(self, rows: DataFrame) -> int:
        """Adds (projector, event_id) pairs; those there already stay single."""
        return self.transact(lambda at, live: live | {"processed": [
            *live["processed"],
            self._write(
                "processed",
                rows.select("projector", "event_id").distinct().join(self.read("processed", at), ["projector", "event_id"], "left_anti")
            )
        ]})

    def put_checkpoints(self, rows: DataFrame) -> int:
        """Moves checkpoints up to the given heads."""
        return self.transact(lambda at, live: self._put(
            at, live, "checkpoints", rows.select("entity_id", F.col("head_seq").alias("checkpoint"))
        ))

    def compact(self, requests: DataFrame) -> DataFrame:
        """Deletes covered prefixes: only files that hold such events are written anew. Returns requests with status and deleted."""
        folder = f"{self.path}/decided/{uuid.uuid4().hex}"

        def change(at: int, live: dict) -> dict | None:
            log, snaps = self.read("events", at), self.read("snapshots", at)
            maintenance.compaction_counts(log, requests, snaps).write.mode("overwrite").parquet(folder)
            done = self.spark.read.parquet(folder).where("deleted > 0").groupBy("entity_id").agg(F.max("through").alias("__through"))
            below = lambda rows: rows.join(done, "entity_id").where("sequence <= __through")
            return self._without(live, "events", below, lambda rows: maintenance.compact(rows, requests, snaps))

        self.transact(change)
        return self.spark.read.parquet(folder)

    def expire(self, now_seconds: int) -> int:
        """Removes what is expired: events by rewriting the files that hold such, views by a delta, snapshots (a row an entity) by a new
        base. Nothing expired: no new version."""
        over = F.col("ttl") <= now_seconds

        def change(at: int, live: dict) -> dict | None:
            new = self._without(
                live, "events", lambda rows: rows.where(over), lambda rows: maintenance.expire(rows, now_seconds)
            ) or dict(live)
            gone = self._live("views", live.get("views", [])).where(over)
            if not gone.isEmpty():
                new = self._put(at, new, "views", gone, gone=True)
            snaps = self._live("snapshots", live.get("snapshots", []))
            if not snaps.where(over).isEmpty():
                new["snapshots"] = [self._write("snapshots", maintenance.expire(snaps, now_seconds), at, base=True)]
            return None if new == live else new

        return self.transact(change)

    def rewrite(self, table: str, partitions: int) -> int:
        """The same rows in ``partitions`` sorted files by key."""
        return self.transact(lambda at, live: live | {table: [self._write(
            table, self.read(table, at).repartition(partitions, KEYS[table][0]), at, base=True
        )]})

    def status(self) -> dict:
        """Health: version, folders and columns of each table."""
        at, live = self.manifest()
        return {
            "version": at,
            "tables": {t: {"folders": len(live.get(t, [])), "columns": s.names, "key": KEYS.get(t, [])} for t, s in self.tables.items()}
        }


def _merged(table: str, rows: DataFrame) -> DataFrame:
    """One row a key of a base and its deltas, by the rules of the table's upsert; summed per task before the shuffle."""
    if table == "heads":
        return rows.groupBy("entity_id").agg(
            F.max_by("entity_type", F.struct("head_seq", -F.col("__version"))).alias("entity_type"), F.max("head_seq").alias("head_seq")
        )
    if table == "checkpoints":
        return rows.groupBy("entity_id").agg(F.max("checkpoint").alias("checkpoint"))
    keys = KEYS[table]
    order = F.struct("event_sequence", "__version", "__arrival") if table == "snapshots" else F.struct("__version", "__arrival")
    rest = [c for c in rows.columns if c not in (*keys, "__version", "__arrival")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("b"))
    return best.select(*keys, "b.*").where("not __gone")


def accept(events: DataFrame, taken: DataFrame, arrival: str = "arrival") -> DataFrame:
    """commit_id, entity_id, accepted: commits of an entity in order of arrival, each rejected if a sequence of it is in ``taken`` (keys of
    the log, of which only those that are offered are dealt out) or comes twice in it. Rows are dealt out by entity and read in order."""
    offered = events.select("entity_id", F.col(arrival).cast("long").alias("at"), "commit_id", "sequence", F.lit(False).alias("taken"))
    met = taken.select("entity_id", "sequence").join(
        events.select("entity_id", "sequence").distinct(), ["entity_id", "sequence"], "left_semi"
    )
    rows = offered.unionByName(met.withColumn("taken", F.lit(True)), allowMissingColumns=True)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, used, commit, held = None, set(), None, []

        def close() -> list:
            if not held:
                return []
            fine = len(set(held)) == len(held) and used.isdisjoint(held)
            if fine:
                used.update(held)
            return [(commit, own, fine)]

        for frame in frames:
            out = []
            for entity, name, seq, there in frame[["entity_id", "commit_id", "sequence", "taken"]].itertuples(index=False):
                if entity != own or not there and name != commit:
                    out += close()
                    if entity != own:
                        used = set()
                    own, commit, held = entity, name, []
                if there:
                    used.add(seq)
                else:
                    held.append(seq)
            yield pd.DataFrame(out, columns=["commit_id", "entity_id", "accepted"])
        yield pd.DataFrame(close(), columns=["commit_id", "entity_id", "accepted"])

    ordered = C.dealt(rows, "entity_id", F.desc("taken"), "at", "commit_id")
    return ordered.mapInPandas(run, "commit_id string, entity_id string, accepted boolean")
