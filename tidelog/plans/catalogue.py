"""Queries over the driver's tables, each with the SQL that it must agree with where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import policy
from ..functions.errors import Conflict, NotFound
from ..operators import commands as CMD
from ..operators import evolve, fold, heads, maintenance, rebuild, snapshots, views
from ..operators.fold import Reducer
from ..sources import log as L
from ..sources import store as ST
from ..sources import tables as T
from ..streaming import consume, publish

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

PREFIX = """with log as (select 'user-'||user_id as entity_id,
       row_number() over (partition by user_id order by ts, event_id)::bigint as sequence, event_type as type,
       (1 + event_id % 2)::bigint as version, 'user' as entity_type, cast(round(value*100) as bigint) as cents,
       cast(json_extract_string(props,'$.k') as bigint) as k, event_id as src_id, ts from events),
 c as (select *, ((sequence-1)//3)::bigint as commit_no, entity_id||':c'||((sequence-1)//3) as commit_id from log),
 commits as (select entity_id, commit_no, (min(sequence)-1)::bigint as cur, count(*)::bigint as n, max(sequence)::bigint as last_seq from c group by 1,2),
 dec as (select *, case when n < 5 - cur % 5 then 0 else n end as take from commits),
 snap as (select entity_id, count(*)::bigint as snapshot_no, max(last_seq)::bigint as event_sequence from dec where take > 0 group by 1)
"""
WHOLE = """, ord as (select 'order-'||o_orderkey as entity_id, 1::bigint as sequence, 'created' as type, 'order' as entity_type, cast(round(o_totalprice*100) as bigint) as cents from orders
   union all select 'order-'||l_orderkey, 1 + row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate), 'line', 'order', cast(round(l_extendedprice*100) as bigint) from lineitem),
 conv as (select 'conv-'||conv_id as entity_id, (turn+1)::bigint as sequence, role as type, 'conversation' as entity_type, length(text)::bigint as cents from conversations),
 whole as (select entity_id, sequence, type, entity_type, cents from log union all select * from conv union all select * from ord)
"""
CHANGES = """, ch as (select *, 'rec-'||src_id as rec, case when src_id % 7 = 0 then 'MODIFY' else 'INSERT' end as event_name, src_id % 11 <> 0 as has_image,
   case when src_id % 13 = 0 then 'missing' when src_id % 17 = 0 then 'invalid_json' end as reason,
   case when src_id % 3 <> 0 then commit_id end as command_id, 't-'||src_id as tp from c),
 kinds as (select *, case when event_name <> 'INSERT' then 'ignored' when not has_image then 'skipped' when reason is not null then 'malformed' else 'ready' end as kind from ch)
"""


def query(sql: str | None = None, prefix: str = PREFIX):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = prefix + sql
        return f

    return add


# scans and reads


@query("select entity_id, sequence, type, entity_type, cents from whole", PREFIX + WHOLE)
def log_scan(spark, d):
    return T.whole_log(spark, d).select("entity_id", "sequence", "type", "entity_type", "cents")


@query("select entity_id, sequence, type, cents from whole where entity_type = 'conversation'", PREFIX + WHOLE)
def log_scan_by_type(spark, d):
    return L.scan(T.whole_log(spark, d), "conversation").select("entity_id", "sequence", "type", "cents")


@query("select entity_id, sequence from whole where cents > 50000 and type in ('purchase', 'line')", PREFIX + WHOLE)
def log_predicate_scan(spark, d):
    return L.scan_where(T.whole_log(spark, d), (F.col("cents") > 50000) & F.col("type").isin("purchase", "line"), "entity_id", "sequence")


@query("select entity_id, sequence, type, cents from log where entity_id = 'user-1'")
def get_events(spark, d):
    return L.events_of(T.user_log(spark, d), "user-1").select("entity_id", "sequence", "type", "cents")


@query("select entity_id, sequence, type, cents from log where entity_id = 'user-1' and sequence > 10")
def get_latest_events(spark, d):
    return L.latest_events(T.user_log(spark, d), "user-1", 10).select("entity_id", "sequence", "type", "cents")


@query("select coalesce(max(sequence), 0)::bigint as max_sequence from log where entity_id = 'user-1'")
def max_sequence(spark, d):
    return L.max_sequence(T.user_log(spark, d), "user-1")


@query("select entity_id from whole union select entity_id from snap", PREFIX + WHOLE)
def entity_ids(spark, d):
    return L.entity_ids(T.whole_log(spark, d), snapshots.floors(T.user_log(spark, d)))


@query("select entity_id, snapshot_no as sequence, event_sequence from snap where entity_id = 'user-1'")
def get_snapshot(spark, d):
    return L.snapshot_of(snapshots.floors(T.user_log(spark, d)), "user-1").select("entity_id", "sequence", "event_sequence")


@query(
    "select entity_id, sequence from log where entity_id in (select entity_id from log group by 1 having max(sequence) % 2 = 0) and entity_id not in (select entity_id from log where entity_id like '%7')"
)
def registry_enumeration(spark, d):
    log = T.user_log(spark, d)
    registry = heads.heads(log).where("head_seq % 2 = 0")
    skip = log.where(F.col("entity_id").endswith("7")).select("entity_id").distinct()
    return L.registered(log, registry, skip).select("entity_id", "sequence")


@query("select entity_id, sequence, entity_id||':'||sequence as event_id, type, 'r' as region, commit_id as command_id from c")
def decode_items(spark, d):
    """Events of the single-table layout, inline snapshots between them."""
    log = T.user_log(spark, d)
    meta = F.concat(F.lit('{"region":"r","commandId":"'), F.col("command_id"), F.lit('"}'))
    null = lambda t: F.lit(None).cast(t)
    items = log.select(
        F.col("entity_id").alias("pk"), F.col("sequence").alias("sk"), "type", "version", F.col("entity_type").alias("entityType"),
        "payload", meta.alias("metadata"), null("long").alias("ttl"), null("long").alias("seq"), null("long").alias("eventSeq")
    )
    inline = snapshots.floors(log).select(
        F.col("entity_id").alias("pk"), F.lit(0).cast("long").alias("sk"), null("string").alias("type"), null("long").alias("version"),
        F.col("entity_type").alias("entityType"), F.lit("{}").alias("payload"), null("string").alias("metadata"), null("long").alias("ttl"),
        F.col("sequence").alias("seq"), F.col("event_sequence").alias("eventSeq")
    )
    return L.decode_items(items.unionByName(inline)).select(
        "entity_id", "sequence", "event_id", "type", F.col("metadata.region").alias("region"),
        F.col("metadata.command_id").alias("command_id")
    )


@query("select entity_id as pk, sequence as sk, type, cents, version % 2 = 1 as flag, [type, 'x'] as tags from log")
def attribute_decode(spark, d):
    """Typed attribute maps to columns."""
    log = T.user_log(spark, d)
    s = lambda tag, c: F.struct(c.alias(tag))
    item = F.to_json(F.struct(
        s("S", F.col("entity_id")).alias("pk"), s("N", F.col("sequence").cast("string")).alias("sk"), s("S", F.col("type")).alias("type"),
        s("N", F.col("cents").cast("string")).alias("cents"), s("BOOL", F.col("version") % 2 == 1).alias("flag"),
        s("SS", F.array("type", F.lit("x"))).alias("tags")
    ))
    return log.select(L.typed_attributes(
        item, "pk string, sk bigint, type string, cents bigint, flag boolean, tags array<string>"
    ).alias("a")).select("a.*")


# sequences, commits, conflicts


@query("select entity_id, sequence, entity_id||':'||sequence as event_id from whole", PREFIX + WHOLE)
def event_id_format(spark, d):
    return T.whole_log(spark, d).select("entity_id", "sequence", C.event_id().alias("event_id"))


@query("select entity_id, sequence, entity_id||':'||sequence as event_id, type, commit_id from c")
def serialize_sequences(spark, d):
    """Commits are taken apart and their events numbered again from the sequence before."""
    log = T.user_log(spark, d)
    events = F.transform(
        F.sort_array(F.collect_list(F.struct("sequence", "type", "version", "payload"))),
        lambda e: F.struct(e["type"].alias("type"), e["version"].alias("version"), e["payload"].alias("payload"))
    )
    results = log.groupBy("entity_id", "entity_type", "commit_id").agg((F.min("sequence") - 1).alias("cur"), events.alias("events")).withColumn("metadata", C.metadata(region=F.lit("r"), command_id=F.col("commit_id")))
    return CMD.serialize(results).select("entity_id", "sequence", "event_id", "type", "commit_id")


@query(
    "select 'order-'||l_orderkey as entity_id, l_linenumber::bigint as sequence, count(*)::bigint as claims from lineitem group by 1, 2 having count(*) > 1",
    ""
)
def commit_conflicts(spark, d):
    """Keys that the store finds claimed more than once."""
    claims = T.claims(spark, d)
    bad = _store(spark).conflicts(claims)
    return claims.join(bad, ["entity_id", "sequence"], "left_semi").groupBy("entity_id", "sequence").agg(F.count("*").alias("claims"))


@query(
    """select entity_id, sequence, rn = 1 as accepted, arrival from (
    select *, row_number() over (partition by entity_id, sequence order by arrival) as rn from (
    select 'order-'||l_orderkey as entity_id, l_linenumber::bigint as sequence, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)::bigint as arrival from lineitem))""",
    "",
)
def commit_accepted(spark, d):
    """Single-event commits in order of arrival: the first claim of a key is accepted."""
    claims = T.claims(spark, d)
    taken = claims.select("entity_id", "sequence").where("false")
    decided = ST.accept(claims, taken)
    return claims.join(decided, ["commit_id", "entity_id"]).select("entity_id", "sequence", "accepted", "arrival")


@query(
    "select 'order-'||l_orderkey as entity_id, (max(l_linenumber) - count(distinct l_linenumber))::bigint as missing from lineitem group by 1 having max(l_linenumber) > count(distinct l_linenumber)",
    ""
)
def sequence_gaps(spark, d):
    return maintenance.gappy(T.claims(spark, d))


@query(
    """select entity_id, "after", "before" from (select entity_id, coalesce(lag(sequence) over (partition by entity_id order by sequence), 0)::bigint as "after", sequence as "before" from
    (select distinct 'order-'||l_orderkey as entity_id, l_linenumber::bigint as sequence from lineitem)) where "before" > "after" + 1""",
    "",
)
def sequence_gap_ranges(spark, d):
    return maintenance.gaps(T.claims(spark, d))


def _store(spark: SparkSession) -> ST.Store:
    """A store of its own in the folder that driver and executors share; only a local master (tests) may leave that unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.sparkContext.setCheckpointDir(root)
    return ST.Store(spark, f"{root.rstrip('/')}/tidelog-store/{uuid.uuid4().hex}").ensure()


@query(
    """select 'events' as what, count(*)::bigint as n from log union all select 'snapshots', count(*) from snap union all select 'versions', 4
    union all select 'conflicts', 1 union all select 'tail', (select count(*) from log l join snap s using (entity_id) where sequence > event_sequence)"""
)
def store_round_trip(spark, d):
    """Append, a conflicting append that changes nothing, snapshots, compaction, all through the manifest store."""
    log, store = T.user_log(spark, d).drop("payload").withColumn("payload", F.lit("{}")), _store(spark)
    store.commit(log.where("sequence <= 30"))
    store.commit(log.where("sequence > 30"))
    n = 0
    try:
        store.commit(log.where("sequence = 7"))
    except Conflict:
        n = 1
    store.put_snapshots(snapshots.floors(log))
    before = store.read("events").select(F.lit("events").alias("what"))
    status = store.compact(store.read("snapshots").select("entity_id", F.col("event_sequence").alias("through")))
    left = store.read("events").select(F.lit("tail").alias("what"))
    assert status.where("status <> 'ok'").isEmpty()
    snaps = store.read("snapshots").select(F.lit("snapshots").alias("what"))
    count = lambda df: df.groupBy("what").agg(F.count("*").alias("n"))
    fixed = spark.range(2).select(
        F.when(F.col("id") == 0, "versions").otherwise("conflicts").alias("what"),
        F.when(F.col("id") == 0, store.version()).otherwise(n).cast("long").alias("n")
    )
    # the first read holds the version from before the compaction: old folders stay readable
    return count(before).unionByName(count(left)).unionByName(count(snaps)).unionByName(fixed)


# heads


@query("select entity_id, entity_type, max(sequence) as head_seq from whole group by 1, 2", PREFIX + WHOLE)
def heads_all(spark, d):
    return heads.heads(T.whole_log(spark, d))


@query("select entity_id, entity_type, max(sequence) as head_seq from whole where entity_type = 'order' group by 1, 2", PREFIX + WHOLE)
def heads_by_type(spark, d):
    return heads.heads(T.whole_log(spark, d), entity_type="order")


def _compacted(spark, d):
    log = T.user_log(spark, d)
    snaps = snapshots.floors(log)
    return maintenance.compact(log, snaps.select("entity_id", F.col("event_sequence").alias("through")), snaps), snaps


@query("select entity_id, max(sequence) as head_seq from log group by 1")
def heads_after_compaction(spark, d):
    log, snaps = _compacted(spark, d)
    return heads.heads(log, snaps).select("entity_id", "head_seq")


def _checkpoints(h: DataFrame) -> DataFrame:
    """Every third entity (by its id's hash) is behind by two, every fourth has no checkpoint."""
    n = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long")
    return h.where(n % 4 != 0).select("entity_id", (F.col("head_seq") - F.when(n % 3 == 0, 2).otherwise(0)).alias("checkpoint"))


CHANGED = """, h as (select entity_id, max(sequence) as head_seq from log group by 1), num as (select *, regexp_extract(entity_id, '([0-9]+)$', 1)::bigint as i from h),
 changed as (select entity_id, head_seq, case when i % 4 = 0 then 0 else head_seq - 2 end::bigint as checkpoint from num where i % 4 = 0 or i % 3 = 0)
"""


@query("select * from changed", PREFIX + CHANGED)
def heads_changed(spark, d):
    h = heads.heads(T.user_log(spark, d))
    return heads.changed(h, _checkpoints(h)).select("entity_id", "head_seq", "checkpoint")


@query("select entity_id, head_seq from h", PREFIX + CHANGED)
def heads_store_merge(spark, d):
    """Disorder, redelivery and useless rows leave the heads table as it is."""
    log = T.user_log(spark, d)
    current = heads.heads(log.where("sequence % 2 = 0"))
    late = heads.heads(log.where("sequence % 2 = 1"))
    junk = late.limit(5).withColumn("head_seq", F.lit(0).cast("long"))
    return heads.merge(current, late, current, junk).select("entity_id", "head_seq")


# folds


def _balance() -> dict[str, Reducer]:
    return {
        "balance": Reducer("sum", F.col("cents"), F.col("type") == "purchase"),
        "purchases": Reducer("count", None, F.col("type") == "purchase")
    }


_BALANCE = "coalesce(sum(cents) filter (type = 'purchase'), 0)::bigint as balance, count(*) filter (type = 'purchase')::bigint as purchases"


@query(f"select entity_id, max(sequence) as head_seq, {_BALANCE} from log group by 1")
def fold_balance(spark, d):
    return fold.fold(T.user_log(spark, d), _balance())


@query("select entity_id, max(sequence) as head_seq, count(*)::bigint as n from whole group by 1", PREFIX + WHOLE)
def fold_counter(spark, d):
    return fold.fold(T.whole_log(spark, d), {"n": Reducer("count")})


@query(
    """select entity_id, max(sequence) as head_seq, arg_max({'v': case when k % 3 = 0 then null else cents end}, sequence).v as other, min(cents) as least, max(cents) as most,
    arg_max({'v': type}, case when type <> 'error' then sequence end).v as last_type from log group by 1"""
)
def fold_last_write(spark, d):
    """The last write wins, null or not."""
    value = F.when(F.col("k") % 3 != 0, F.col("cents"))
    return fold.fold(
        T.user_log(spark, d),
        {
            "other": Reducer("last", value), "least": Reducer("min", F.col("cents")), "most": Reducer("max", F.col("cents")),
            "last_type": Reducer("last", F.col("type"), F.col("type") != "error")
        }
    )


def _account(state, event):
    opened = event["type"] == "signup"
    return F.struct(
        F.when(opened, event["cents"]).when(
            event["type"] == "purchase", state["balance"] + event["cents"]
        ).otherwise(state["balance"]).alias("balance"),
        (state["opened"] | opened).alias("opened"),
    )


def _fresh():
    return F.struct(F.lit(0).cast("long").alias("balance"), F.lit(False).alias("opened"))


RESET = """, r as (select *, max(sequence) filter (type = 'signup') over (partition by entity_id) as opened_at from log),
 account as (select entity_id, max(sequence) as head_seq, (coalesce(sum(cents) filter (type = 'purchase' and sequence > coalesce(opened_at, 0)), 0) + coalesce(sum(cents) filter (sequence = opened_at), 0))::bigint as balance, max(opened_at) is not null as opened from r group by 1)
"""


@query("select * from account", PREFIX + RESET)
def fold_reset_balance(spark, d):
    """Opening sets the balance, depositing adds: a step that depends on order."""
    return fold.fold_ordered(T.user_log(spark, d), ["type", "cents"], _fresh(), _account).select("entity_id", "head_seq", "state.*")


@query("select * from account", PREFIX + RESET)
def fold_python_state(spark, d):
    """The same account by a Python step over sorted partitions."""

    def step(state, event):
        if event["type"] == "signup":
            return {"balance": int(event["cents"]), "opened": True}
        if event["type"] == "purchase":
            return {"balance": state["balance"] + int(event["cents"]), "opened": state["opened"]}
        return state

    return fold.fold_python(
        T.user_log(spark, d), ["type", "cents"], lambda _: {"balance": 0, "opened": False}, step, "balance bigint, opened boolean"
    ).drop("error")


@query(
    "select entity_id, sequence, sum(case when type = 'purchase' then cents else 0 end) over (partition by entity_id order by sequence)::bigint as balance from log"
)
def fold_running_state(spark, d):
    """State after each event."""
    return fold.running(T.user_log(spark, d), {"balance": Reducer("sum", F.col("cents"), F.col("type") == "purchase")})


@query(
    "select entity_id, max(sequence) as head_seq, coalesce(sum(cents) filter (type = 'line'), 0)::bigint as lines_cents, count(*) filter (type = 'line')::bigint as n_lines, coalesce(max(cents) filter (type = 'created'), 0) as total from ord group by 1",
    PREFIX + WHOLE
)
def fold_order_totals(spark, d):
    state = fold.fold(
        T.order_log(spark, d),
        {
            "lines_cents": Reducer("sum", F.col("cents"), F.col("type") == "line"),
            "n_lines": Reducer("count", None, F.col("type") == "line"), "total": Reducer("max", F.col("cents"), F.col("type") == "created")
        }
    )
    return state.withColumn("total", F.coalesce("total", F.lit(0)))


def _seeds(log: DataFrame) -> DataFrame:
    floors = snapshots.floors(log)
    covered = log.join(floors.select("entity_id", "event_sequence"), "entity_id").where("sequence <= event_sequence")
    state = fold.fold(covered, _balance()).drop("head_seq")
    return floors.select("entity_id", "event_sequence").join(state, "entity_id")


@query(f"select entity_id, max(sequence) as head_seq, {_BALANCE} from log group by 1")
def fold_seeded(spark, d):
    log = T.user_log(spark, d)
    return fold.fold_seeded(log, _seeds(log), _balance())


@query(f"select entity_id, max(sequence) as head_seq, {_BALANCE} from log group by 1")
def fold_seeded_after_compaction(spark, d):
    log = T.user_log(spark, d)
    left, _ = _compacted(spark, d)
    return fold.fold_seeded(left, _seeds(log), _balance())


@query("select * from account", PREFIX + RESET)
def fold_ordered_seeded(spark, d):
    """The ordered fold from snapshots equals the full one."""
    log = T.user_log(spark, d)
    floors = snapshots.floors(log).select("entity_id", "event_sequence")
    covered = log.join(floors, "entity_id").where("sequence <= event_sequence")
    seeds = floors.join(fold.fold_ordered(covered, ["type", "cents"], _fresh(), _account).select("entity_id", "state"), "entity_id")
    return fold.fold_ordered(log, ["type", "cents"], _fresh(), _account, seeds=seeds).select("entity_id", "head_seq", "state.*")


@query(f"select entity_id, max(sequence) as head_seq, {_BALANCE} from log where entity_id = 'user-1' group by 1")
def load_entity(spark, d):
    log = L.scan_where(T.user_log(spark, d), F.col("entity_id") == "user-1")
    return fold.fold_seeded(log, _seeds(log), _balance())


# snapshots, maintenance


@query("select entity_id, commit_no, cur, n, take::bigint as take from dec")
def snapshot_decision(spark, d):
    return snapshots.taken(T.user_log(spark, d)).select(
        "entity_id", F.regexp_extract("commit_id", r"(\d+)$", 1).cast("long").alias("commit_no"), "cur", "n", "take"
    )


@query("select entity_id, snapshot_no as sequence, event_sequence from snap")
def snapshots_build(spark, d):
    return snapshots.floors(T.user_log(spark, d)).select("entity_id", "sequence", "event_sequence")


@query(
    """, inc as (select entity_id, last_seq as event_sequence, commit_no as arrival, 'p'||commit_no as payload from commits union all select entity_id, last_seq, commit_no + 1000, 'q'||commit_no from commits where commit_no % 2 = 0)
    select entity_id, max(event_sequence) as event_sequence, arg_max(payload, event_sequence * 100000 + arrival) as payload from inc group by 1"""
)
def snapshot_monotonic_upsert(spark, d):
    """Snapshots arrive in any order; the greatest event_sequence stays, of equal ones the later."""
    c = snapshots.commits(T.user_log(spark, d)).withColumn("no", F.regexp_extract("commit_id", r"(\d+)$", 1).cast("long"))
    row = lambda p, at: c.select(
        "entity_id", F.col("last_seq").alias("event_sequence"), F.concat(F.lit(p), F.col("no").cast("string")).alias("payload"),
        at.alias("arrival"), "no"
    )
    inc = row("p", F.col("no")).unionByName(row("q", F.col("no") + 1000).where("no % 2 = 0"))
    current = inc.where("no < 3 and arrival < 1000").groupBy("entity_id").agg(
        F.min("event_sequence").alias("event_sequence"), F.lit("old").alias("payload")
    )
    return snapshots.upsert(current, inc)


DEBT = """, debt as (select l.entity_id, max(sequence) as head_seq, coalesce(max(event_sequence), 0) as event_sequence, count(*) filter (sequence > coalesce(event_sequence, 0))::bigint as since from log l left join snap s using (entity_id) group by 1)
"""


@query(
    "select entity_id, head_seq, event_sequence, since, (since * 8)::bigint as estimate_ms, since > 2 as exceeded from debt", PREFIX + DEBT
)
def freshness(spark, d):
    log = T.user_log(spark, d)
    return snapshots.freshness(log, snapshots.floors(log), budget=2)


@query(
    "select entity_id, 'user' as entity_type, s.snapshot_no + 1 as sequence, head_seq as event_sequence from debt join snap s using (entity_id) where since >= 2",
    PREFIX + DEBT
)
def catch_up_candidates(spark, d):
    log = T.user_log(spark, d)
    snaps = snapshots.floors(log)
    states = fold.fold(log, {"n": Reducer("count")}).select(
        "entity_id", F.lit("user").alias("entity_type"), "head_seq", C.to_json(F.struct("n")).alias("payload")
    )
    return snapshots.catch_up(states, snaps, snapshots.freshness(log, snaps), 2).drop("payload")


@query("select l.entity_id, l.sequence from log l left join snap s using (entity_id) where sequence > coalesce(event_sequence, 0)")
def compact_remaining(spark, d):
    return _compacted(spark, d)[0].select("entity_id", "sequence")


@query(
    """, req as (select entity_id, case i % 3 when 0 then 0 when 1 then event_sequence else event_sequence + 1 end as through from (select *, regexp_extract(entity_id, '([0-9]+)$', 1)::bigint as i from snap))
    select r.entity_id, through, case when through < 1 then 'noop' when event_sequence < through then 'uncovered' else 'ok' end as status, case when through >= 1 and event_sequence >= through then through else 0 end::bigint as deleted from req r join snap using (entity_id)"""
)
def compact_status(spark, d):
    log = T.user_log(spark, d)
    snaps = snapshots.floors(log)
    i = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long") % 3
    req = snaps.select(
        "entity_id",
        F.when(i == 0, 0).when(i == 1, F.col("event_sequence")).otherwise(F.col("event_sequence") + 1).cast("long").alias("through")
    )
    return maintenance.compaction_counts(log, req, snaps)


@query(
    "select entity_id, sequence, (epoch(ts)::bigint + 86400) as ttl from (select entity_id, sequence, date_trunc('second', ts) as ts from log) union all select entity_id, sequence, null from conv",
    PREFIX + WHOLE
)
def ttl_stamp(spark, d):
    u = T.user_log(spark, d).select("entity_id", "sequence", "entity_type", "ts")
    c = T.conversation_log(spark, d).select("entity_id", "sequence", "entity_type", F.lit(None).cast("timestamp_ntz").alias("ts"))
    return u.unionByName(c).select(
        "entity_id", "sequence", maintenance.ttl(F.col("entity_type"), {"user": 86400}, F.col("ts")).alias("ttl")
    )


@query(
    "select entity_id, sequence from log where epoch(date_trunc('second', ts))::bigint + 86400 > epoch(timestamp '2024-01-15 00:00:00')::bigint"
)
def ttl_expire(spark, d):
    log = T.user_log(spark, d).withColumn("ttl", maintenance.ttl(F.col("entity_type"), {"user": 86400}, F.col("ts")))
    return maintenance.expire(log, 1705276800).select("entity_id", "sequence")


# schema evolution


def _chain():
    v2 = lambda p: C.to_json(F.struct(
        (F.get_json_object(p, "$.cents").cast("long") + 1).alias("cents"), F.get_json_object(p, "$.k").cast("long").alias("k")
    ))
    v3 = lambda p: F.when(
        F.get_json_object(p, "$.k").cast("long") % 10 != 9,
        C.to_json(F.struct((F.get_json_object(p, "$.cents").cast("long") * 2).alias("cents")))
    )
    return [evolve.Upcaster("purchase", 1, v2, 2), evolve.Upcaster("purchase", 2, v3, 3, "bought")]


UPCAST = """, up as (select *, case when type = 'purchase' and k % 10 <> 9 then 'bought' else type end as type2, case when type <> 'purchase' then version when k % 10 = 9 then 2 else 3 end::bigint as version2,
 case when type <> 'purchase' then cents when k % 10 = 9 then cents + case version when 1 then 1 else 0 end else (cents + case version when 1 then 1 else 0 end) * 2 end::bigint as cents2, case when type = 'purchase' and k % 10 = 9 then 'upcast' end as failed from log)
"""


@query("select entity_id, sequence, type2 as type, version2 as version, cents2 as cents, failed as failed_phase from up", PREFIX + UPCAST)
def upcast_chain(spark, d):
    out = evolve.upcast(T.user_log(spark, d).select("entity_id", "sequence", "type", "version", "payload"), _chain())
    return out.select(
        "entity_id", "sequence", "type", "version", F.get_json_object("payload", "$.cents").cast("long").alias("cents"), "failed_phase"
    )


@query(
    "select entity_id, sequence, type2 as type, version2 as version, coalesce(failed, 'deserialize') as phase from up where failed is not null or type = 'error' or (type = 'view' and k % 5 = 0)",
    PREFIX + UPCAST
)
def strict_decode_errors(spark, d):
    """Unknown types (error), payloads that don't fit (every fifth view) and failed upcasts fail closed."""
    log = T.user_log(spark, d).select(
        "entity_id", "sequence", "type", "version",
        F.when((F.col("type") == "view") & (F.col("k") % 5 == 0), '{"cents":"x"').otherwise(F.col("payload")).alias("payload")
    )
    kinds = {t: "cents bigint, k bigint" for t in ("purchase", "bought", "view", "click", "signup")}
    out = evolve.strict_decode(evolve.upcast(log, _chain()), kinds).where("error is not null")
    return out.select("entity_id", "sequence", "error.type", "error.version", "error.phase")


@query("select entity_id, sequence, greatest(version - 1, 1) as version, case when k % 4 <> 0 then 'r' end as region from log")
def lenient_decode(spark, d):
    rows = T.user_log(spark, d).select(
        "entity_id", "sequence", (F.col("version") - 1).alias("version"),
        F.when(F.col("k") % 4 == 0, '{"region":').otherwise('{"region":"r"}').alias("metadata_json")
    )
    return evolve.lenient_decode(rows).select("entity_id", "sequence", "version", F.col("metadata.region").alias("region"))


@query(
    "select entity_id, sequence, commit_id as command_id, 'src' as source, case when k % 2 = 0 then null else 'addr' end as address, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') as stamp from c"
)
def metadata_build(spark, d):
    m = C.metadata(
        region=F.lit("r"), timestamp=F.col("ts"), command_id=F.col("command_id"), source=F.lit("src"), endpoint=F.lit("e"),
        address=F.when(F.col("k") % 2 == 0, "").otherwise("addr")
    )
    out = T.user_log(spark, d).select("entity_id", "sequence", C.metadata_from_json(C.metadata_to_json(m)).alias("m"))
    return out.select("entity_id", "sequence", "m.command_id", "m.origin.source", "m.address", F.col("m.timestamp").alias("stamp"))


@query(
    "select event_id, row_number() over (order by command_id, event_id)::bigint as rank from (select entity_id||':'||sequence as event_id, commit_id as command_id from c where entity_id = 'user-1')"
)
def sort_by_command(spark, d):
    log = T.user_log(spark, d).where("entity_id = 'user-1'")
    return CMD.sort_by_command(log, F.col("command_id"), F.col("event_id"), "entity_id").select("event_id", "rank")


@query(
    "select event_id, row_number() over (order by event_id)::bigint as rank from (select entity_id||':'||sequence as event_id from log where entity_id = 'user-1')"
)
def sort_by_event_id(spark, d):
    log = T.user_log(spark, d).where("entity_id = 'user-1'")
    return CMD.sort_by_command(log, F.lit(None).cast("string"), F.col("event_id"), "entity_id").select("event_id", "rank")


# commands


def _offered(log: DataFrame) -> DataFrame:
    """All commands ever sent, once more."""
    return log.groupBy("entity_id", "command_id").agg(F.min("sequence").alias("arrival"), F.count("*").alias("events"))


@query(
    "select c.entity_id, commit_id as command_id, min(sequence) as arrival, count(*)::bigint as events from c left join snap s using (entity_id) group by 1, 2 having max(sequence) <= coalesce(max(event_sequence), 0)"
)
def command_dedupe_since_snapshot(spark, d):
    """Sent again, commands from before the snapshot pass: only later ones are remembered."""
    log = T.user_log(spark, d)
    return CMD.fresh_commands(_offered(log), CMD.seen_commands(log, snapshots.floors(log)))


@query("select entity_id, commit_id as command_id from c where false")
def command_dedupe_all(spark, d):
    log = T.user_log(spark, d)
    return CMD.fresh_commands(_offered(log), CMD.seen_commands(log, None, "all")).select("entity_id", "command_id")


@query(
    """, cmd as (select entity_id, sequence, case when type = 'signup' then 'open' else 'deposit' end as name, min(sequence) filter (type = 'signup') over (partition by entity_id) as first_open from log where type in ('signup', 'purchase'))
    select entity_id, sequence as arrival, case when name = 'open' then (case when sequence = first_open then 'accepted' else 'rejected' end) when sequence > coalesce(first_open, 1000000000) then 'accepted' else 'rejected' end as status,
    case when name = 'open' and sequence <> first_open then 'Conflict: account open' when name = 'deposit' and sequence < coalesce(first_open, 1000000000) then 'NotFound: account not open' end as error from cmd"""
)
def command_execute(spark, d):
    """Accounts: opening twice is a conflict, depositing before opening is not found."""
    log = T.user_log(spark, d).where("type in ('signup', 'purchase')")
    cmds = log.select(
        "entity_id", F.concat("entity_id", F.lit("#"), F.col("sequence").cast("string")).alias("command_id"),
        F.when(F.col("type") == "signup", "open").otherwise("deposit").alias("name"), F.col("cents").cast("string").alias("body"),
        F.col("sequence").alias("arrival")
    )

    def handle(state, command):
        if command["name"] == "open":
            if state["opened"]:
                raise Conflict("account open")
            return [{"type": "opened", "payload": command["body"]}]
        if not state["opened"]:
            raise NotFound("account not open")
        return [{"type": "deposited", "payload": command["body"]}]

    def apply(state, event):
        amount = int(event["payload"])
        return {"opened": True, "balance": amount if event["type"] == "opened" else state["balance"] + amount}

    none = log.limit(0).select("entity_id", "sequence", "type", F.lit("").alias("payload"), F.lit("").alias("command_id"))
    done = CMD.execute(none, cmds, lambda _: {"opened": False, "balance": 0}, apply, handle)
    return done.select("entity_id", "arrival", "status", "error")


# views

VIEWS = """, st as (select entity_id, max(sequence) as head_seq, coalesce(sum(cents) filter (type = 'purchase'), 0)::bigint as balance, arg_max({'v': case when k % 3 = 0 then null else k end}, sequence).v as last_k from log group by 1),
 v as (select 'user#'||entity_id as pk, 'VIEW' as sk, entity_id, 'user' as entity_type, '{"balance":'||balance||',"last_k":'||coalesce(last_k::varchar, 'null')||'}' as payload, balance from st)
"""


def _views(spark, d) -> DataFrame:
    state = fold.fold(
        T.user_log(spark, d), {"balance": _balance()["balance"], "last_k": Reducer("last", F.when(F.col("k") % 3 != 0, F.col("k")))}
    )
    return views.project(state.withColumn("entity_type", F.lit("user")), "balance", "last_k")


_KEYS = ["pk", "sk", "payload"]


@query("select pk, sk, entity_id, entity_type, payload, null::bigint as ttl from v", PREFIX + VIEWS)
def view_project(spark, d):
    return _views(spark, d)


@query("select pk, sk, payload from v where pk = 'user#user-1'", PREFIX + VIEWS)
def view_get(spark, d):
    return views.get(_views(spark, d), "user#user-1").select(*_KEYS)


@query("select pk, sk, payload from v where entity_type = 'user'", PREFIX + VIEWS)
def view_list_type(spark, d):
    return views.list_type(_views(spark, d), "user").select(*_KEYS)


LINES = """, lv as (select 'ORDER#'||l_orderkey as pk, 'L'||printf('%05d', row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) as sk, '{"qty":'||l_quantity::bigint||'}' as payload from lineitem)
"""


def _line_views(spark, d) -> DataFrame:
    lines = T.order_log(spark, d).where("type = 'line'")
    return lines.select(
        F.concat(F.lit("ORDER#"), F.substring_index("entity_id", "-", -1)).alias("pk"),
        F.concat(F.lit("L"), F.lpad((F.col("sequence") - 1).cast("string"), 5, "0")).alias("sk"), "entity_id", "entity_type",
        C.to_json(F.struct(F.col("k").alias("qty"))).alias("payload"), F.lit(None).cast("long").alias("ttl")
    )


@query("select pk, sk, payload from lv where pk = (select min(pk) from lv)", PREFIX + LINES)
def view_list_pk(spark, d):
    v = _line_views(spark, d)
    return views.list_pk(v, v.agg(F.min("pk")).first()[0]).select(*_KEYS)


@query("select pk, sk, payload from v where pk in ('user#user-1', 'user#user-3', 'user#user-5')", PREFIX + VIEWS)
def view_batch_get(spark, d):
    keys = spark.range(7).select(F.when(F.col("id") == 0, "").when(F.col("id") == 6, "user#none").otherwise(F.concat(
        F.lit("user#user-"), (F.col("id") % 3 * 2 + 1).cast("string")
    )).alias("pk"))
    return views.batch_get(_views(spark, d), keys).select(*_KEYS)


@query(
    """, inc as (select entity_id, sequence, case when k % 2 = 0 then 'VIEW' else 'K' end as sk, '{"cents":'||cents||'}' as payload from log)
    select 'user#'||entity_id as pk, sk, arg_max(payload, sequence) as payload from inc group by 1, 2"""
)
def view_upsert(spark, d):
    """Every event writes a view; the last by key stays. A blank sk is VIEW."""
    log = T.user_log(spark, d)
    rows = log.select(
        C.view_pk().alias("pk"), F.when(F.col("k") % 2 == 0, "").otherwise("K").alias("sk"), "entity_id", "entity_type",
        C.to_json(F.struct("cents")).alias("payload"), F.lit(None).cast("long").alias("ttl"), F.col("sequence").alias("arrival")
    )
    return views.upsert(
        _views(spark, d).limit(0).unionByName(rows.where("sequence < 5").drop("arrival").dropDuplicates(["pk", "sk"])), rows
    ).select(*_KEYS)


@query("select pk, sk, payload from v where balance >= 50000", PREFIX + VIEWS)
def view_delete(spark, d):
    v = _views(spark, d)
    small = v.where(F.get_json_object("payload", "$.balance").cast("long") < 50000).select("pk", F.lit("").alias("sk"))
    return views.delete(v, small).select(*_KEYS)


@query(
    "select pk, sk, payload from (select *, row_number() over (order by pk, sk) as rn from v) where rn between 11 and 20", PREFIX + VIEWS
)
def view_page(spark, d):
    """The second page of ten."""
    v = _views(spark, d)
    _, after = views.page(v, 10)
    return views.page(v, 10, after)[0].select(*_KEYS)


@query(
    """select pk, replace(replace(base64(encode('{"pk":"'||pk||'","sk":"'||sk||'"}')), '+', '-'), '/', '_') as cursor, sk as back from lv""",
    PREFIX + LINES
)
def cursor_codec(spark, d):
    v = _line_views(spark, d).select("pk", "sk", views.cursor(F.col("pk"), F.col("sk")).alias("cursor"))
    return v.select("pk", "cursor", views.uncursor(F.col("cursor"))["sk"].alias("back"))


def _spoilt(spark, d) -> DataFrame:
    i = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long")
    bad = F.when(i % 10 == 0, "{").when(i % 10 == 1, '{"balance":"x"}').when(
        i % 10 == 2, F.lit(None).cast("string")
    ).otherwise(F.col("payload"))
    return _views(spark, d).withColumn("payload", bad)


@query(
    "select pk, balance, last_k from v join st using (entity_id) where regexp_extract(v.entity_id, '([0-9]+)$', 1)::bigint % 10 > 2".replace("select pk, balance", "select pk, v.balance"),
    PREFIX + VIEWS
)
def view_decode_valid(spark, d):
    return views.decode_valid(_spoilt(spark, d), "balance bigint, last_k bigint").select("pk", "value.balance", "value.last_k")


@query("select pk, sk from v where regexp_extract(entity_id, '([0-9]+)$', 1)::bigint % 10 <= 2", PREFIX + VIEWS)
def view_decode_errors(spark, d):
    return views.decode_errors(_spoilt(spark, d), "balance bigint, last_k bigint")


# rebuilds

STATES = """, states as (select entity_id, case when regexp_extract(entity_id, '([0-9]+)$', 1)::bigint % 9 = 0 then 'other' else 'user' end as entity_type, regexp_extract(entity_id, '([0-9]+)$', 1)::bigint % 10 = 3 as bad from log group by 1)
"""


def _states(spark, d) -> DataFrame:
    i = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long")
    return fold.fold(T.user_log(spark, d), _balance()).withColumns({
        "entity_type": F.when(i % 9 == 0, "other").otherwise("user"), "error": F.when(i % 10 == 3, "bad event")
    })


@query(
    "select count(*) filter (not bad and entity_type = 'user')::bigint as processed, count(*) filter (not bad and entity_type <> 'user')::bigint as skipped, count(*) filter (bad)::bigint as errors from states",
    PREFIX + STATES
)
def rebuild_summary(spark, d):
    return rebuild.summary_of(_states(spark, d), "user")


@query("select 'user#'||entity_id as pk from states where not bad and entity_type = 'user'", PREFIX + STATES)
def rebuild_views(spark, d):
    """A full rebuild into the store."""
    store = _store(spark)
    rebuild.run(_states(spark, d), [lambda s: views.project(s, "balance")], store.put_views, "user")
    return store.read("views").select("pk")


@query(
    f"select entity_id, max(sequence) as head_seq, {_BALANCE} from log where entity_id in (select entity_id from changed) group by 1",
    PREFIX + CHANGED
)
def rebuild_incremental(spark, d):
    """Only entities whose head is over their checkpoint are folded."""
    log = T.user_log(spark, d)
    h = heads.heads(log)
    return fold.fold(rebuild.changed_log(log, h, _checkpoints(h)), _balance())


@query("select entity_id, max(head_seq) as checkpoint from h group by 1", PREFIX + CHANGED)
def checkpoints_advance(spark, d):
    h = heads.heads(T.user_log(spark, d))
    return heads.advance(_checkpoints(h), h)


# streaming: publishing


@query(
    "select entity_id||':'||sequence as event_id, entity_id, sequence, type from kinds where event_name = 'INSERT' and has_image",
    PREFIX + CHANGES
)
def stream_filter_insert(spark, d):
    return L.change_records(T.changes(spark, d)).select("event_id", "entity_id", "sequence", "type")


@query("select rec as event_id, reason from kinds where kind = 'malformed'", PREFIX + CHANGES)
def malformed_rows(spark, d):
    return publish.prepared(T.changes(spark, d), "example.events").where("kind = 'malformed'").select("event_id", "reason")


@query(
    "select entity_id||':'||sequence as event_id, entity_id, 'user' as entity_type, type, sequence, version, '{\"cents\":'||cents||',\"k\":'||k||'}' as payload, null::varchar as reject from kinds where kind = 'ready'",
    PREFIX + CHANGES
)
def envelope(spark, d):
    """Envelopes, written and read back."""
    ready = publish.prepared(T.changes(spark, d), "example.events").where("kind = 'ready'").select("message")
    return L.decode_envelopes(ready).select("event_id", "entity_id", "entity_type", "type", "sequence", "version", "payload", "reject")


@query(
    "select rec as event_id, 'user' as entity_type, type as event_type, command_id, tp as traceparent, coalesce(command_id, tp) as correlation_id from kinds where kind = 'ready'",
    PREFIX + CHANGES
)
def message_attributes(spark, d):
    a = lambda n: F.try_element_at("attributes", F.lit(n))
    ready = publish.prepared(T.changes(spark, d), "example.events").where("kind = 'ready'")
    return ready.select(
        "event_id", a("entityType").alias("entity_type"), a("eventType").alias("event_type"), a("commandId").alias("command_id"),
        a("traceparent").alias("traceparent"), a("correlationId").alias("correlation_id")
    )


@query(
    "select rec as event_id, entity_id as group_id, entity_id||':'||sequence as dedup_id from kinds where kind = 'ready' and type = 'purchase'",
    PREFIX + CHANGES
)
def fifo_targets(spark, d):
    group = lambda df: F.when(F.col("new_image.type") == "purchase", F.col("entity_id"))
    return publish.ordered_targets(publish.prepared(
        T.changes(spark, d), "example.events", group
    )).select("event_id", "group_id", "dedup_id")


@query(
    "select rec as event_id, ((row_number() over (partition by entity_id order by src_id) - 1) // 10)::bigint as batch from kinds where kind = 'ready'",
    PREFIX + CHANGES
)
def publish_batches(spark, d):
    return publish.batches(
        publish.prepared(T.changes(spark, d), "example.events").where("kind = 'ready'"), "src_id", "entity_id"
    ).select("event_id", "batch")


def _published(spark, d) -> DataFrame:
    rows = publish.prepared(T.changes(spark, d), "example.events", lambda df: F.when(F.col("src_id") % 2 == 0, F.col("entity_id")))
    send = lambda ready: ready.where("src_id % 19 = 0")
    ordered = lambda ready: ready.where("src_id % 23 = 0")
    return publish.publish(rows, send, ordered, throttled=F.col("src_id") % 29 == 0, retry_allowed=F.col("src_id") % 4 != 0)


STATUS = """, status as (select *, case when kind <> 'ready' then kind when src_id % 29 = 0 then 'throttled' when src_id % 19 = 0 or (src_id % 2 = 0 and src_id % 23 = 0) then (case when src_id % 4 <> 0 then 'failed' else 'dropped' end) else 'published' end as s from kinds)
"""


@query(
    "select " + ", ".join(f"count(*) filter (s = '{x}')::bigint as {x}" for x in (
        "published", "failed", "skipped", "malformed", "throttled", "dropped", "ignored"
    )) + " from status",
    PREFIX + CHANGES + STATUS
)
def publish_summary(spark, d):
    return publish.summary(_published(spark, d))


@query(
    "select case when src_id % 5 = 0 then rec else src_id::varchar end as item_id from status where s in ('failed', 'throttled')",
    PREFIX + CHANGES + STATUS
)
def publish_failures(spark, d):
    return publish.failures(_published(spark, d))


@query(
    """with recursive steps as (select user_id, event_id, row_number() over (partition by user_id order by epoch_us(ts) // 600, event_id) as n, epoch_us(ts) // 600 as us from events),
    bucket as (select user_id, n, event_id, us, true as allowed, 0::bigint as tokens from steps where n = 1
      union all select s.user_id, s.n, s.event_id, s.us, least(60000000, b.tokens + s.us - b.us) >= 60000000,
        (least(60000000, b.tokens + s.us - b.us) - case when least(60000000, b.tokens + s.us - b.us) >= 60000000 then 60000000 else 0 end)::bigint
      from bucket b join steps s on s.user_id = b.user_id and s.n = b.n + 1)
    select event_id, allowed from bucket""",
    "",
)
def token_bucket(spark, d):
    """One event a minute for each user, on a clock on which ten hours are a minute."""
    clock = F.timestamp_micros(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600).cast("long"))
    rows = T.table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("key"), clock.alias("clock"))
    return publish.token_bucket(rows, "key", "clock", 1, "event_id").select("event_id", "allowed")


# streaming: consuming


@query("select entity_id||':'||sequence as event_id from c where sequence % 3 <> 0")
def idempotency_pending(spark, d):
    log = T.user_log(spark, d)
    processed = log.where("sequence % 3 = 0").select(
        F.lit("p").alias("projector"), "event_id"
    ).unionByName(log.select(F.lit("q").alias("projector"), "event_id"))
    return consume.pending(log.select("event_id"), processed, "p")


def _streamed(spark, d) -> tuple[DataFrame, str]:
    # a pattern: the table may be one file or a folder
    stream = consume.read_stream(spark, f"{d}/events.parque[t]", T.table(spark, d, "events").schema)
    return stream, f"{_store(spark).path}-checkpoint"


@query("select 'user-'||user_id as entity_id, max(event_id) as head_seq from events where event_id >= 1 group by 1", "")
def stream_heads(spark, d):
    """Heads kept by a stream over the events; a sequence is the event's own number."""
    stream, checkpoint = _streamed(spark, d)
    store = _store(spark)
    events = stream.select(
        F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("entity_id"), F.lit("user").alias("entity_type"),
        F.col("event_id").alias("sequence")
    )
    consume.keep_heads(store, events, checkpoint).awaitTermination()
    return store.read("heads").select("entity_id", "head_seq")


@query("select 'user#user-'||user_id as pk, '{\"type\":\"'||arg_max(event_type, event_id)||'\"}' as payload from events group by 1", "")
def stream_views(spark, d):
    """The last event of each user as a view, kept by a stream."""
    stream, checkpoint = _streamed(spark, d)
    store = _store(spark)

    def project(df: DataFrame) -> DataFrame:
        id_ = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
        return df.select(
            F.concat(F.lit("user#"), id_).alias("pk"), F.lit("").alias("sk"), id_.alias("entity_id"), F.lit("user").alias("entity_type"),
            C.to_json(F.struct(F.col("event_type").alias("type"))).alias("payload"), F.lit(None).cast("long").alias("ttl"),
            F.col("event_id").alias("arrival")
        )

    consume.keep_views(store, stream, project, checkpoint).awaitTermination()
    return store.read("views").select("pk", "payload")


@query("select event_id::varchar as event_id, case when event_id % 10 = 0 then 2 else 1 end::bigint as times from events", "")
def stream_idempotent(spark, d):
    """Two deliveries of everything: what failed at first is tried again, what was processed is not."""
    store = _store(spark)
    stream, _ = _streamed(spark, d)
    seen: list[str] = []

    def projector(rows: DataFrame) -> DataFrame:
        folder = f"{store.path}/seen/{len(seen)}"
        rows.select("event_id").write.parquet(folder)
        seen.append(folder)
        return rows.where("cast(event_id as bigint) % 10 = 0").select("event_id") if len(seen) == 1 else None

    for i in range(2):
        consume.keep_projected(
            store, "p", projector, stream.select(F.col("event_id").cast("string").alias("event_id")), f"{store.path}-c{i}"
        ).awaitTermination()
    return spark.read.parquet(*seen).groupBy("event_id").agg(F.count("*").alias("times"))


@query("select 'm-'||src_id as message_id from c where src_id % 10 = 0")
def queue_partial_failures(spark, d):
    """Queue messages whose events a projector fails on are named by message id."""
    log = T.user_log(spark, d)
    detail = publish.event_json(
        F.col("event_id"), F.col("sequence"), F.col("type"), F.col("version"), F.col("entity_id"), F.col("entity_type"), F.col("payload"),
        F.lit('{"region":"r"}')
    )
    messages = log.select(
        F.concat(F.lit("m-"), F.col("src_id").cast("string")).alias("message_id"),
        publish.envelope("s", F.col("event_id"), F.col("type"), detail).alias("message"), F.col("src_id")
    )
    messages = messages.unionByName(messages.withColumn("message", F.lit("{")).withColumn(
        "message_id", F.concat(F.lit("bad-"), F.col("message_id"))
    ))
    fail = lambda rows: rows.where("src_id % 10 = 0").select("event_id")
    return consume.queue_failures(_store(spark), "p", fail, messages)


@query(
    "select 'aws:sqs' as source, 'm-'||event_id as message_id, 'b'||event_id as message, null::varchar as error from events where event_id % 3 = 0 union all select 'aws:sns', 'm-'||event_id, 'b'||event_id, null from events where event_id % 3 = 1 union all select 'x', null, null, 'unsupported event source' from events where event_id % 3 = 2",
    ""
)
def transport_normalize(spark, d):
    s = F.col("event_id").cast("string")
    queue = F.concat(F.lit('{"Records":[{"eventSource":"aws:sqs","messageId":"m-'), s, F.lit('","body":"b'), s, F.lit('"}]}'))
    topic = F.concat(F.lit('{"Records":[{"EventSource":"aws:sns","Sns":{"MessageId":"m-'), s, F.lit('","Message":"b'), s, F.lit('"}}]}'))
    other = F.lit('{"Records":[{"EventSource":"x"}]}')
    raw = T.table(spark, d, "events").select(
        F.when(F.col("event_id") % 3 == 0, queue).when(F.col("event_id") % 3 == 1, topic).otherwise(other).alias("raw")
    )
    return L.normalize_notifications(raw)


# policy


@query(
    "select event_id, case event_id % 6 when 0 then 'transient' when 1 then 'transient' when 2 then 'permanent' when 3 then 'unknown' when 4 then 'transient' else 'permanent' end as class from events",
    ""
)
def retry_class(spark, d):
    codes = F.array(*(F.array(*map(F.lit, x)) for x in (
        ["ThrottlingError", ""], ["TransactionConflict", "ValidationError"], ["AccessDenied", "Other"], ["Other", "None"],
        ["ConditionalCheckFailed", ""], ["ValidationError", ""]
    )))
    return T.table(spark, d, "events").select(
        "event_id", policy.class_of_codes(F.element_at(codes, (F.col("event_id") % 6 + 1).cast("int"))).alias("class")
    )


@query(
    "select distinct event_id % 7 as attempt, (least(100 * power(2, event_id % 7), 2000)::bigint // 2)::bigint as delay_ms from events", ""
)
def backoff_delays(spark, d):
    a = F.col("event_id") % 7
    return T.table(spark, d, "events").select(
        a.alias("attempt"), policy.backoff_ms(F.lit(100), F.lit(2000), a).alias("delay_ms")
    ).distinct()
