"""Queries that drive the store, the command runner, the publisher and the consumers as wholes, each with the SQL that it must agree
with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import doctor
from ..functions import columns as C
from ..functions import errors as E
from ..functions.policy import Classified
from ..operators import commands as CMD
from ..operators import fold, heads, layers, rebuild, snapshots, views
from ..sources import log as L
from ..sources import tables as T
from ..sources import writes as W
from ..sources.runner import CommandRunner
from ..streaming import consume, publish
from .catalogue import CHANGES, PREFIX, STATES, VIEWS, _balance, _spoilt, _states, _store, _views, query

RECURSIVE = (PREFIX + CHANGES).replace("with log", "with recursive log", 1)


def _events(spark, d) -> DataFrame:
    return T.user_log(spark, d).withColumn("payload", F.lit("{}"))


def _one(spark, **facts) -> DataFrame:
    """One row of long columns."""
    return spark.range(1).select(*(F.lit(v).cast("long").alias(k) for k, v in facts.items()))


# the store


@query(
    "select entity_id, snapshot_no as sequence, event_sequence, n as events from snap join (select entity_id, count(*)::bigint as n from log group by 1) using (entity_id)"
)
def commit_with_snapshot(spark, d):
    """Events and their snapshots appear in one version; a snapshot without events is refused."""
    log, store = _events(spark, d), _store(spark)
    store.commit(log, snapshots.floors(log))
    try:
        store.commit(log.limit(0), snapshots.floors(log))
        raise AssertionError("a snapshot without events was taken")
    except ValueError:
        pass
    counts = store.read("events").groupBy("entity_id").agg(F.count("*").alias("events"))
    return store.read("snapshots").join(counts, "entity_id").select("entity_id", "sequence", "event_sequence", "events")


@query("select entity_id, sequence from log where sequence % 4 <> 0")
def raw_delete(spark, d):
    log, store = _events(spark, d), _store(spark)
    store.commit(log)
    store.delete_events(log.where("sequence % 4 = 0"), unsafe=True)
    return store.read("events").select("entity_id", "sequence")


@query(
    "select l.entity_id, l.sequence from log l left join snap s using (entity_id) where not (sequence <= coalesce(event_sequence, 0) and regexp_extract(entity_id, '([0-9]+)$', 1)::bigint % 2 = 0)"
)
def store_compact(spark, d):
    """Compaction of half of the entities in a store of several commits: what is left."""
    log, store = _events(spark, d), _store(spark)
    for part in ("sequence <= 20", "sequence > 20"):
        store.commit(log.where(part))
    store.put_snapshots(snapshots.floors(log))
    even = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long") % 2 == 0
    store.compact(store.read("snapshots").where(even).select("entity_id", F.col("event_sequence").alias("through")))
    return store.read("events").select("entity_id", "sequence")


@query("select entity_id, sequence from log where src_id % 3 <> 0 or 1000 + src_id > 3000")
def store_expire(spark, d):
    log, store = _events(spark, d).withColumn("ttl", F.when(F.col("src_id") % 3 == 0, 1000 + F.col("src_id"))), _store(spark)
    store.commit(log)
    store.expire(3000)
    return store.read("events").select("entity_id", "sequence")


@query(
    """select entity_id||'/'||arrival as commit_id, entity_id, rn = 1 and sequence <> 1 as accepted from (
    select *, row_number() over (partition by entity_id, sequence order by arrival) as rn from (
    select 'order-'||l_orderkey as entity_id, l_linenumber::bigint as sequence, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::bigint as arrival from lineitem))""",
    "",
)
def commit_stream(spark, d):
    """Many commits against a log that holds the first sequence of each entity already: each is decided by itself."""
    claims, store = T.claims(spark, d), _store(spark)
    store.commit(claims.where("sequence = 1").select("entity_id", "sequence").distinct())
    return store.commit_stream(claims)


@query("select entity_id, sequence, accepted from (select entity_id, sequence, sequence > 2 as accepted from log where sequence <= 5)")
def commit_conflict_check(spark, d):
    """Keys that the store finds taken in its log."""
    log, store = _events(spark, d), _store(spark)
    store.commit(log.where("sequence <= 2"))
    offered = log.where("sequence <= 5").select("entity_id", "sequence")
    bad = store.conflicts(offered).withColumn("bad", F.lit(True))
    return offered.join(bad, ["entity_id", "sequence"], "left").select("entity_id", "sequence", F.col("bad").isNull().alias("accepted"))


@query(
    "select * from (values ('events', 11, 'entity_id,sequence', 1), ('snapshots', 7, 'entity_id', 1), ('views', 6, 'pk,sk', 0), ('heads', 3, 'entity_id', 0), ('processed', 2, 'projector,event_id', 0), ('checkpoints', 2, 'entity_id', 0)) t(what, columns, key, folders)",
    ""
)
def store_health(spark, d):
    """What the doctor reads of a store, and of the schema it would make."""
    log, store = _events(spark, d).limit(100), _store(spark)
    store.commit(log, snapshots.floors(log))
    found, schema = store.status()["tables"], doctor.schema()
    return spark.createDataFrame(
        [(t, len(schema[t]["columns"]), ",".join(x["key"]), x["folders"]) for t, x in found.items()],
        "what string, columns int, key string, folders int"
    )


# commands


@query(
    "select entity_id, case when commit_no % 3 = 0 then commit_id||'x' else commit_id end as command_id from commits join (select distinct entity_id, commit_no, commit_id from c) using (entity_id, commit_no) where commit_no % 3 = 0"
)
def command_dedupe_fresh(spark, d):
    """Commands of which a third are new ones: only these pass."""
    log = T.user_log(spark, d)
    offered = log.select(
        "entity_id", "commit_no",
        F.when(F.col("commit_no") % 3 == 0, F.concat("commit_id", F.lit("x"))).otherwise(F.col("commit_id")).alias("command_id")
    ).distinct()
    return CMD.fresh_commands(offered, CMD.seen_commands(log, None, "all")).select("entity_id", "command_id")


def _commands(spark, d) -> DataFrame:
    log = T.user_log(spark, d).where("type in ('signup', 'purchase')")
    name = F.when(F.col("type") == "signup", "open").otherwise("deposit")
    return log.select(
        "entity_id", F.concat("entity_id", F.lit("#"), F.col("sequence").cast("string")).alias("command_id"), name.alias("name"),
        F.col("cents").cast("string").alias("body"), F.col("sequence").alias("arrival")
    )


def _handle(state, command):
    if command["name"] == "open":
        if state["opened"]:
            raise E.Conflict("account open")
        return [{"type": "opened", "payload": command["body"]}]
    if not state["opened"]:
        raise E.NotFound("account not open")
    return [{"type": "deposited", "payload": command["body"]}]


def _apply(state, event):
    amount = int(event["payload"])
    return {"opened": True, "balance": amount if event["type"] == "opened" else state["balance"] + amount}


def _start(_):
    return {"opened": False, "balance": 0}


def _project(states: DataFrame) -> DataFrame:
    return views.project(states.withColumn("balance", F.get_json_object("state", "$.balance").cast("long")), "balance")


CMDS = """, cmd as (select entity_id, sequence, cents, case when type = 'signup' then 'open' else 'deposit' end as name, min(sequence) filter (type = 'signup') over (partition by entity_id) as first_open from log where type in ('signup', 'purchase'))
"""


@query(
    """select entity_id, sequence as arrival, case when name = 'open' then (case when sequence = first_open then 'accepted' else 'rejected' end) when sequence > coalesce(first_open, 1000000000) then 'accepted' else 'rejected' end as status from cmd""",
    PREFIX + CMDS,
)
def command_runner(spark, d):
    """Two batches through the runner with a snapshot at every fifth event: the second goes on from what the first left."""
    store, cmds = _store(spark), _commands(spark, d)
    runner = CommandRunner(store, "account", _start, _apply, _handle, every=5, project=_project)
    done = runner.run(cmds.where("arrival <= 30"))
    return done.unionByName(runner.run(cmds.where("arrival > 30"))).select("entity_id", "arrival", "status")


@query(
    """, replayed as (select *, case when sequence <= 30 and first_open <= 30 and (name = 'deposit' and sequence > first_open or sequence = first_open) then 'duplicate'
      when name = 'open' then (case when sequence = first_open then 'accepted' else 'rejected' end)
      when first_open <= 30 or sequence > coalesce(first_open, 1000000000) then 'accepted' else 'rejected' end as status from cmd)
    select entity_id, sequence as arrival, status from replayed""",
    PREFIX + CMDS,
)
def command_replay(spark, d):
    """All commands once more after a first batch was committed: its commands are duplicates, the others meet its state."""
    store, cmds = _store(spark), _commands(spark, d)
    runner = CommandRunner(store, "account", _start, _apply, _handle, every=10**9)
    runner.run(cmds.where("arrival <= 30"))
    log = store.read("events").withColumn("command_id", F.col("metadata.command_id"))
    return CMD.execute(log, cmds, _start, _apply, _handle).select("entity_id", "arrival", "status")


@query(
    """select 'account#'||entity_id as pk, '{"balance":'||sum(cents)::bigint||'}' as payload from cmd where sequence >= first_open and (name = 'deposit' or sequence = first_open) group by entity_id""",
    PREFIX + CMDS,
)
def command_projection(spark, d):
    """Views that the runner publishes in the same version as the events."""
    store, cmds = _store(spark), _commands(spark, d)
    runner = CommandRunner(store, "account", _start, _apply, _handle, project=_project)
    for part in ("arrival <= 10", "arrival > 10"):
        runner.run(cmds.where(part))
    return store.read("views").select("pk", "payload")


# heads, views, rebuilds


@query(
    "select count(*)::bigint as visited, sum(n)::bigint as total, 10::bigint as stopped_after from (select count(*) as n from log group by entity_id)"
)
def heads_visitor(spark, d):
    """Every entity is visited once; a visitor may stop."""
    h = heads.heads(T.user_log(spark, d))
    seen: list[int] = []
    n = heads.visit(h, lambda row: seen.append(row.head_seq))
    calls: list[int] = []
    stopped = heads.visit(h, lambda row: calls.append(1) or len(calls) < 10)
    return _one(spark, visited=n, total=sum(seen), stopped_after=stopped)


@query(
    "select entity_id, count(*)::bigint as head_seq, (select count(distinct entity_id) from log)::bigint as upserted from log group by 1"
)
def heads_backfill(spark, d):
    """A heads table that lacks some entities and is behind for others, filled from the log and the snapshots."""
    log = T.user_log(spark, d)
    stale = heads.heads(log.where("src_id % 2 = 0 and sequence <= 20"))
    filled, n = heads.backfill(stale, log, snapshots.floors(log))
    return filled.select("entity_id", "head_seq", F.lit(n).cast("long").alias("upserted"))


@query("select 5::bigint as stopped_after, count(*)::bigint as visited from v", PREFIX + VIEWS)
def view_early_stop(spark, d):
    rows, calls, every = _views(spark, d), [], []
    views.each(rows, lambda row: calls.append(row.pk) or len(calls) < 5)
    views.each(rows, lambda row: every.append(row.pk))
    return _one(spark, stopped_after=len(calls), visited=len(every))


@query("select pk, payload from v where balance % 3 <> 0 union all select pk||'!', payload from v where balance % 2 = 0", PREFIX + VIEWS)
def transaction_groups(spark, d):
    """Groups of writes that are merged and published in one version: two puts and a deletion."""
    rows, store = _views(spark, d), _store(spark)
    store.put_views(rows)
    at = store.version()
    more = rows.where("cast(get_json_object(payload, '$.balance') as bigint) % 2 = 0").withColumn("pk", F.concat("pk", F.lit("!")))
    gone = rows.where("cast(get_json_object(payload, '$.balance') as bigint) % 3 = 0")
    first = W.Transaction([W.WriteSet("views", more.where("entity_id < 'user-5'"))])
    second = W.Transaction().add(W.WriteSet(
        "views", more.where("entity_id >= 'user-5'")
    ).merge(None)).add(None).add(W.WriteSet("views", gone.select("pk", "sk"), "delete"))
    if store.apply(first.merge(second).merge(None)) != at + 1:
        raise AssertionError("the groups took more than one version")
    return store.read("views").select("pk", "payload")


@query(
    "select 'user#'||entity_id as pk, (select count(*) from states where bad or entity_type = 'user')::bigint as calls, (select count(*) from states where not bad and entity_type = 'user')::bigint as processed, (select count(*) from states where bad)::bigint as errors from states where not bad and entity_type = 'user'",
    PREFIX + STATES
)
def rebuild_progress(spark, d):
    """Progress is told for each entity that was processed or failed."""
    store, calls = _store(spark), []
    rebuild.run(
        _states(spark, d), [lambda s: views.project(s, "balance")], store.put_views, "user",
        on_progress=lambda done, bad: calls.append((done, bad))
    )
    done, bad = calls[-1]
    return store.read("views").select(
        "pk", F.lit(len(calls)).cast("long").alias("calls"), F.lit(done).cast("long").alias("processed"),
        F.lit(bad).cast("long").alias("errors")
    )


@query(
    "select 'user#'||entity_id as pk, (select count(*) from states where bad)::bigint as errors from states where not bad and entity_type = 'user'",
    PREFIX + STATES
)
def rebuild_by_query(spark, d):
    """A rebuild from states that were folded from an enumeration of ids; a seed is refused."""
    store = _store(spark)
    done = rebuild.by_query(_states(spark, d), [lambda s: views.project(s, "balance")], store.put_views, "user", "user")
    for wrong in ({"seed": 1}, {"enumerate_type": "other"}):
        try:
            rebuild.by_query(_states(spark, d), [lambda s: s], store.put_views, "user", **wrong)
            raise AssertionError("a rebuild by query took what it must refuse")
        except ValueError:
            pass
    return store.read("views").select("pk", F.lit(len(done.errors)).cast("long").alias("errors"))


@query(
    "select pk, balance, (select count(*) from v where regexp_extract(entity_id, '([0-9]+)$', 1)::bigint % 7 = 0) > 0 as stopped from v",
    PREFIX + VIEWS
)
def view_list_strict(spark, d):
    """A strict list reads all values, or stops at the first bad payload."""
    good = views.decode_strict(_views(spark, d), "balance bigint, last_k bigint")
    try:
        views.decode_strict(
            _spoilt(spark, d), "balance bigint, last_k bigint"
        ).select("value").write.format("noop").mode("overwrite").save()
        stopped = False
    except Exception:  # noqa: BLE001
        stopped = True
    return good.select("pk", "value.balance", F.lit(stopped).alias("stopped"))


@query("select 'acc#'||entity_id as pk, balance * 2 as balance from v", PREFIX + VIEWS)
def view_store(spark, d):
    """Typed values put twice (the later ones stay) and listed."""
    values = fold.fold(T.user_log(spark, d), _balance()).select(F.col("entity_id").alias("id"), "balance")
    store = views.ViewStore(views.ViewStore.empty(spark), "acc", "id string, balance bigint")
    store.put(values, "id")
    store.put(values.withColumn("balance", F.col("balance") * 2), "id")
    return store.list().select("pk", "balance")


@query(
    "select count(distinct entity_id)::bigint as calls, count(distinct entity_id)::bigint as seen, (select count(*) from (select l.entity_id, count(*) filter (sequence > coalesce(event_sequence, 0)) as n from log l left join snap s on s.entity_id = l.entity_id group by 1) where n > 1)::bigint as exceeded from log"
)
def freshness_observer(spark, d):
    """Each entity's replay debt is given to an observer once; one that raises stops nothing."""
    log, got = T.user_log(spark, d), []

    def observer(row):
        got.append(row.exceeded)
        if len(got) % 10 == 0:
            raise RuntimeError("an observer's own fault")

    n = snapshots.observe(snapshots.freshness(log, snapshots.floors(log), budget=1), observer)
    return _one(spark, calls=n, seen=len(got), exceeded=sum(got))


@query(
    """, recursive_layers as (select entity_id, length(entity_id)::bigint as n from log group by 1)
    select entity_id as node, (regexp_extract(entity_id, '([0-9]+)$', 1)::bigint // 40)::bigint as layer from recursive_layers"""
)
def graph_layers(spark, d):
    """Longest paths: every fortieth entity depends on the one forty before it, and on one eighty before it."""
    n = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long")
    nodes = T.user_log(spark, d).select("entity_id").distinct().select(F.col("entity_id").alias("node"), n.alias("n"))
    last = nodes.agg(F.max("n")).first()[0]
    every = spark.range(0 if last is None else last + 1).select(
        F.col("id").alias("n"), F.concat(F.lit("user-"), F.col("id").cast("string")).alias("node")
    )
    edge = lambda by: every.where(f"n >= {by}").select(
        F.concat(F.lit("user-"), (F.col("n") - by).cast("string")).alias("src"), F.col("node").alias("dst")
    )
    _store(spark)  # names the checkpoint folder where it is unset
    return layers.layers(every.select("node"), edge(40).unionByName(edge(80))).join(nodes.select("node"), "node", "left_semi")


# publishing and consuming


BUDGETS = """, entering as (select *, epoch_us(ts) // 600 as us, case when event_name <> 'INSERT' then 'ignored' when not has_image then 'skipped' end as out from ch),
 asked as (select *, row_number() over (partition by entity_id order by us, case when src_id % 5 = 0 then rec else src_id::varchar end) as n from entering where out is null),
 first_bucket as (select entity_id, n, src_id, us, true as allowed, 60000000::bigint as tokens from asked where n = 1
   union all select s.entity_id, s.n, s.src_id, s.us, least(120000000, b.tokens + (s.us - b.us) * 2) >= 60000000,
     (least(120000000, b.tokens + (s.us - b.us) * 2) - case when least(120000000, b.tokens + (s.us - b.us) * 2) >= 60000000 then 60000000 else 0 end)::bigint
   from first_bucket b join asked s on s.entity_id = b.entity_id and s.n = b.n + 1),
 sent as (select a.*, allowed, case when not allowed then 'throttled' when reason is not null then 'malformed' when a.src_id % 4 = 0 or (a.src_id % 2 = 0 and a.src_id % 3 = 0) then 'bad' else 'published' end as outcome from asked a join first_bucket b using (entity_id, n)),
 again as (select *, row_number() over (partition by entity_id order by n) as m from sent where outcome = 'bad'),
 second_bucket as (select entity_id, m, src_id, us, true as allowed, 0::bigint as tokens from again where m = 1
   union all select s.entity_id, s.m, s.src_id, s.us, least(60000000, b.tokens + s.us - b.us) >= 60000000,
     (least(60000000, b.tokens + s.us - b.us) - case when least(60000000, b.tokens + s.us - b.us) >= 60000000 then 60000000 else 0 end)::bigint
   from second_bucket b join again s on s.entity_id = b.entity_id and s.m = b.m + 1)
 select rec as event_id, out as status from entering where out is not null
 union all select rec, outcome from sent where outcome <> 'bad'
 union all select a.rec, case when b.allowed then 'failed' else 'dropped' end from again a join second_bucket b using (entity_id, m)
"""


@query(BUDGETS, RECURSIVE)
def publisher_handler(spark, d):
    """The publisher as a whole: two events a minute for each entity on a clock on which ten hours are a minute, then one retry."""
    clock = T.user_log(spark, d).select(
        "src_id", F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600).cast("long")).alias("clock"),
        F.col("entity_id").alias("lane")
    )
    rows = publish.prepared(
        T.changes(spark, d).join(clock, "src_id"), "example.events", lambda df: F.when(F.col("src_id") % 2 == 0, F.col("lane"))
    )
    send = lambda ready: ready.where("src_id % 4 = 0")
    ordered = lambda ready: ready.where("src_id % 3 = 0")
    return publish.handle(rows, send, ordered, lane="lane", ts="clock", ingress=2, retries=1).select("event_id", "status")


@query(
    "select entity_id||':'||sequence as dedup_id, 1::bigint as times from kinds where kind = 'ready' and src_id % 2 = 0", PREFIX + CHANGES
)
def publish_ordered_once(spark, d):
    """Change records delivered twice: the ordered topic gets each event once."""
    store, changes = _store(spark), T.changes(spark, d)
    rows = publish.prepared(changes.unionByName(changes), "example.events", lambda df: F.when(F.col("src_id") % 2 == 0, F.col("entity_id")))
    path = f"{store.path}/sent/{uuid.uuid4().hex}"

    def ordered(ready: DataFrame) -> DataFrame:
        ready.select("dedup_id").write.parquet(path)
        return ready.limit(0)

    publish.publish(rows, lambda ready: ready.limit(0), ordered)
    return spark.read.parquet(path).groupBy("dedup_id").agg(F.count("*").alias("times"))


def _messages(log: DataFrame) -> DataFrame:
    detail = publish.event_json(
        F.col("event_id"), F.col("sequence"), F.col("type"), F.col("version"), F.col("entity_id"), F.col("entity_type"), F.col("payload"),
        F.lit('{"region":"r"}')
    )
    return log.select(
        F.concat(F.lit("m-"), F.col("src_id").cast("string")).alias("message_id"),
        publish.envelope("s", F.col("event_id"), F.col("type"), detail).alias("message")
    )


@query("select entity_id||':'||sequence as event_id, true as failed from log where src_id % 2 = 1")
def topic_handler(spark, d):
    """Topic messages: a batch without failures is marked as processed; one failure fails a whole batch."""
    store, log = _store(spark), T.user_log(spark, d)
    consume.topic_batch(store, "p", lambda rows: None, _messages(log.where("src_id % 2 = 1")))
    try:
        consume.topic_batch(store, "p", lambda rows: rows.limit(1).select("event_id"), _messages(log.where("src_id % 2 = 0").limit(50)))
        failed = False
    except Classified:
        failed = True
    odd = log.where("src_id % 2 = 1").select("event_id")
    return store.read("processed").join(odd, "event_id", "left_semi").select("event_id", F.lit(failed).alias("failed"))


@query(
    "select entity_id||':'||sequence as event_id from kinds where event_name = 'INSERT' and has_image and src_id % 6 <> 0", PREFIX + CHANGES
)
def direct_stream_handler(spark, d):
    """Change records straight to a projector: inserts only, what fails is not marked."""
    store = _store(spark)
    own = T.changes(spark, d).select(
        C.event_id(F.col("new_image.pk"), F.col("new_image.sk")).alias("event_id"), "src_id"
    ).where("event_id is not null")
    bad = own.where("src_id % 6 = 0").select("event_id")
    consume.process(
        store, "p", lambda rows: rows.join(bad, "event_id", "left_semi").select("event_id"), L.change_records(T.changes(spark, d))
    )
    return store.read("processed").select("event_id")


@query("select entity_id||':'||sequence as event_id from log")
def guard_unreadable(spark, d):
    """A guard whose table is lost stops nothing: all records go through."""
    store, log = _store(spark), T.user_log(spark, d).select("event_id")
    store.mark_processed(log.select(F.lit("p").alias("projector"), "event_id"))
    for folder in store.manifest()[1]["processed"]:
        store._fs.delete(store._path(folder), True)
    path = f"{store.path}/seen/{uuid.uuid4().hex}"
    consume.process(store, "p", lambda rows: rows.write.parquet(path), log)
    return spark.read.parquet(path)


@query(
    "select entity_id as id, cents, [cents, version]::bigint[] as numbers, [type, 'x'] as names, type as inner_type, [sequence, sequence + 1]::bigint[] as inner_list, null::varchar as nothing, type as raw from log"
)
def attribute_decode_nested(spark, d):
    """Attributes of every type: sets, lists and maps within maps, binaries and nulls."""
    tag = lambda t, c: F.struct(c.alias(t))
    n = lambda c: tag("N", c.cast("string"))
    text = lambda c: F.col(c).cast("string")
    inner = F.struct(tag("S", F.col("type")).alias("kind"), tag("L", F.array(n(F.col("sequence")), n(F.col("sequence") + 1))).alias("list"))
    item = F.struct(
        tag("S", F.col("entity_id")).alias("id"), n(F.col("cents")).alias("cents"),
        tag("NS", F.array(text("cents"), text("version"))).alias("numbers"), tag("SS", F.array("type", F.lit("x"))).alias("names"),
        tag("M", inner).alias("inner"), tag("NULL", F.lit(True)).alias("nothing"),
        tag("B", F.base64(F.encode("type", "utf-8"))).alias("raw")
    )
    schema = "id string, cents bigint, numbers array<bigint>, names array<string>, inner struct<kind:string,list:array<bigint>>, nothing string, raw binary"
    found = T.user_log(spark, d).select(L.typed_attributes(F.to_json(item), schema).alias("a")).select("a.*")
    return found.select(
        "id", "cents", "numbers", "names", F.col("inner.kind").alias("inner_type"), F.col("inner.list").alias("inner_list"), "nothing",
        F.col("raw").cast("string").alias("raw")
    )


# errors


@query(
    "select event_id, case when value < 50 then 'not found' when event_id % 5 = 0 then 'Command not recognized: '||event_type when event_id % 7 = 0 then 'duplicate command: '||event_id else (event_id * 2 + 1)::varchar end as outcome from events",
    ""
)
def result_combinators(spark, d):
    """A value or a domain error through map, bind, zip and or_else, row by row."""
    rows = T.table(spark, d, "events").select("event_id", "event_type", (F.col("value") < 50).alias("low"))

    def outcome(i: int, kind: str, low: bool) -> str:
        def find():
            if low:
                raise E.NotFound("not found")
            return i

        def check(n: int) -> E.Result:
            return E.Result(error=E.BadCommand(kind)) if n % 5 == 0 else E.Result(n)

        def once():
            if i % 7 == 0:
                raise E.DuplicateCommand(str(i))
            return 1

        got = E.Result.of(find).bind(check).zip(E.Result.of(once)).map(lambda pair: pair[0] * 2 + pair[1])
        return str(got.unwrap()) if got.ok else str(got.error) if isinstance(got.error, E.DomainError) else str(got.or_else("none"))

    def run(frames):
        for f in frames:
            yield f[["event_id"]].assign(outcome=[outcome(int(i), k, bool(low)) for i, k, low in f.itertuples(index=False)])

    return rows.mapInPandas(run, "event_id bigint, outcome string")

