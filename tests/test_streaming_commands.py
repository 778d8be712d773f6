import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.functions import policy
from tidelog.functions import schemas as S
from tidelog.functions.errors import Conflict, DuplicateCommand, Result
from tidelog.operators import commands, heads
from tidelog.sources import log as L
from tidelog.sources import store as ST
from tidelog.streaming import consume, publish

GOOD = '{"commandId":"c1","trace":{"traceparent":"tp"},"region":"r"}'


def change(spark, *metas, name="INSERT"):
    return spark.createDataFrame([(f"r{i}", name, str(i), ("a", i + 1, "t", 1, "x", "{}", m, None, None, None) if m is not None else None) for i, m in enumerate(metas)], S.CHANGE)


def test_prepared_and_summary(spark, rows):
    df = change(spark, GOOD, '{"region":"us-east-1"', " ", None, '{"region":"r"}').unionByName(change(spark, GOOD, name="MODIFY"))
    got = publish.prepared(df, "example.events", lambda d: F.when(F.col("entity_id") == "a", F.lit("g")))
    assert [r.kind for r in got.collect()] == ["ready", "malformed", "malformed", "skipped", "ready", "ignored"]
    first = got.first()
    assert first.attributes == {"entityType": "x", "eventType": "t", "commandId": "c1", "traceparent": "tp", "correlationId": "c1"}
    assert (first.group_id, first.dedup_id) == ("g", "a:1")
    back = L.decode_envelopes(got.where("kind = 'ready'").limit(1)).first()
    assert (back.event_id, back.payload, back.reject) == ("a:1", "{}", None)
    sent = publish.publish(got, lambda r: r.where("key = 'a:5'"))
    assert publish.summary(sent).first().asDict() == {"published": 1, "failed": 1, "skipped": 1, "malformed": 2, "throttled": 0, "dropped": 0, "ignored": 1}
    assert rows(publish.failures(sent)) == [("4",)]
    lost = publish.publish(got, lambda r: r, retry_allowed=F.lit(False))
    assert publish.failures(lost).isEmpty() and publish.summary(lost).first().dropped == 2


def test_ordered_topic_first(spark):
    order = []
    got = publish.prepared(change(spark, GOOD), "s", lambda d: F.lit("g"))
    publish.publish(got, lambda r: order.append("plain") or r, lambda r: order.append("ordered") or r)
    assert order == ["ordered", "plain"]


@pytest.mark.parametrize(("rate", "times", "want"), [(2, [0, 0, 0, 30, 30, 90], [True, True, False, True, False, True]), (0, [0, 0], [True, True]), (1, [60, 0, 61], [True, False, False])])
def test_bucket(rate, times, want):
    b = publish.Bucket(rate, times[0] * 10**6)
    assert [b.allow(t * 10**6) for t in times] == want


def test_bucket_per_key(spark, rows):
    df = spark.createDataFrame([("a", 0, 1), ("a", 1, 2), ("b", 0, 3)], "k string, s long, id long").withColumn("ts", F.timestamp_seconds("s"))
    assert rows(publish.token_bucket(df, "k", "ts", 1, "id"), "id", "allowed") == [(1, True), (2, False), (3, True)]


@pytest.fixture()
def store(spark, tmp_path):
    return ST.Store(spark, f"file://{tmp_path}/s").ensure()


def records(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "event_id string")


def test_runtime_marks_only_what_worked(spark, store, rows):
    seen = []

    def projector(df):
        seen.append(sorted(r.event_id for r in df.collect()))
        return df.where("event_id = 'b'")

    assert rows(consume.process(store, "p", projector, records(spark, "a", "b", "a"))) == [("b",)]
    consume.process(store, "p", projector, records(spark, "a", "b", "c"))
    assert seen == [["a", "a", "b"], ["b", "c"]]
    assert rows(store.read("processed"), "event_id") == [("a",), ("c",)]
    assert consume.process(store, "p", projector, records(spark, "a", "c")).isEmpty() and len(seen) == 2


def test_runtime_error_classes(spark, store, rows):
    def raising(e):
        def projector(df):
            raise e

        return projector

    permanent = policy.Classified(policy.PERMANENT, ValueError("x"))
    assert rows(consume.process(store, "p", raising(permanent), records(spark, "a", "b"))) == [("a",), ("b",)]
    with pytest.raises(ValueError):
        consume.process(store, "p", raising(ValueError("x")), records(spark, "a"))
    assert store.read("processed").isEmpty()


def test_queue_and_topic(spark, store, rows):
    event = '{"id":"e","source":"s","detail":{"id":"a:%d","sequence":1,"type":"t","version":1,"entityId":"a","entityType":"x","payload":"e30="}}'
    messages = spark.createDataFrame([("m1", event % 1), ("m2", event % 2), ("m3", event % 2), ("m4", "{")], "message_id string, message string")
    assert rows(consume.queue_failures(store, "q", lambda d: d.where("event_id = 'a:2'"), messages)) == [("m3",)]
    with pytest.raises(policy.Classified):
        consume.topic_batch(store, "t", lambda d: d, messages)
    consume.topic_batch(store, "t", lambda d: None, messages)


def test_streamed_heads_equal_batch(spark, store, tmp_path, rows):
    log = spark.createDataFrame([(f"e{i % 5}", "x", i // 5 + 1) for i in range(50)], "entity_id string, entity_type string, sequence long")
    log.repartition(7).write.parquet(f"{tmp_path}/log")
    for i in range(2):  # redelivery changes nothing
        stream = consume.read_stream(spark, f"{tmp_path}/log", log.schema, files=2)
        consume.keep_heads(store, stream, f"{tmp_path}/c{i}").awaitTermination()
        assert rows(store.read("heads")) == rows(heads.heads(log).select("entity_id", "entity_type", "head_seq"))


def account():
    def handle(state, command):
        if command["name"] == "open":
            if state["opened"]:
                raise Conflict("open")
            return [{"type": "opened", "payload": command["body"]}]
        return [{"type": "added", "payload": command["body"]}, {"type": "added", "payload": "1"}]

    def apply(state, event):
        return {"opened": True, "sum": state["sum"] + int(event["payload"])}

    return (lambda _: {"opened": False, "sum": 0}), apply, handle


def test_execute(spark, rows):
    log = spark.createDataFrame([("a", 1, "opened", "5", "k1")], "entity_id string, sequence long, type string, payload string, command_id string")
    cmds = spark.createDataFrame([("a", "k1", "add", "1", 1), ("a", "k2", "open", "1", 2), ("a", "k3", "add", "7", 3), ("a", "k3", "add", "7", 4), ("b", None, "open", "1", 1)], "entity_id string, command_id string, name string, body string, arrival long")
    got = commands.execute(log, cmds, *account())
    assert rows(got, "entity_id", "arrival", "status", "error") == [("a", 1, "duplicate", "duplicate command: k1"), ("a", 2, "rejected", "Conflict: open"), ("a", 3, "accepted", None), ("a", 4, "duplicate", "duplicate command: k3"), ("b", 1, "accepted", None)]
    made = got.where("status = 'accepted'").select("entity_id", F.explode("events").alias("e")).select("entity_id", "e.sequence", "e.payload")
    assert rows(made) == [("a", 2, "7"), ("a", 3, "1"), ("b", 1, "1")]
    seeds = spark.createDataFrame([("a", 4, '{"opened":true,"sum":9}')], "entity_id string, event_sequence long, state string")
    after = commands.execute(log, cmds.where("arrival = 1 and entity_id = 'a'"), *account(), seeds=seeds)
    assert after.select("status", "events").first()[0] == "accepted"  # the dedupe window starts at the snapshot


def test_sort_orders(spark):
    df = spark.createDataFrame([("e:10", "b"), ("e:2", "a")], "event_id string, command_id string")
    order = lambda c: [r.event_id for r in commands.sort_by_command(df, c, F.col("event_id")).orderBy("rank").collect()]
    assert order(F.col("command_id")) == ["e:2", "e:10"]
    assert order(F.lit(None).cast("string")) == ["e:10", "e:2"]


def test_retry():
    waits, tries = [], []

    def op():
        tries.append(1)
        if len(tries) < 3:
            raise Conflict("race")
        return "done"

    assert policy.Retry(attempts=5, jitter=None, sleep=waits.append).run(op) == "done"
    assert waits == [0.05, 0.1]
    with pytest.raises(policy.Classified) as e:
        policy.Retry(sleep=waits.append).run(lambda: 1 / 0)
    assert e.value.kind == policy.UNKNOWN and len(waits) == 2
    assert all(policy.delay(0.1, 2, k) <= 2 for k in range(80))


def test_results():
    assert Result.of(lambda: 1).map(lambda x: x + 1).zip(Result(3)).unwrap() == (2, 3)
    bad = Result.of(lambda: [][0]).bind(lambda x: Result(x))
    assert not bad.ok and bad.or_else(4) == 4
    with pytest.raises(IndexError):
        bad.unwrap()
    assert str(DuplicateCommand("k")) == "duplicate command: k"


def test_streamed_bucket_keeps_its_state(spark, tmp_path, rows):
    data = [(i, "a" if i % 2 else "b", i * 20) for i in range(12)]
    df = spark.createDataFrame(data, "id long, k string, s long").withColumn("ts", F.timestamp_seconds("s"))
    for i in range(3):  # a file a batch, in order
        df.where(f"id div 4 = {i}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = consume.read_stream(spark, f"{tmp_path}/in", df.schema, files=1)
    out = publish.token_bucket_stream(stream, "k", "ts", 1, "id")
    out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    want = rows(publish.token_bucket(df, "k", "ts", 1, "id"), "id", "allowed")
    assert rows(spark.read.parquet(f"{tmp_path}/out"), "id", "allowed") == want and {x for _, x in want} == {True, False}


def test_command_runner(spark, store, rows):
    from tidelog.operators import views
    from tidelog.sources.runner import CommandRunner

    begin, apply, handle = account()
    project = lambda s: views.project(s, "state")
    runner = CommandRunner(store, "bank", begin, apply, handle, every=3, project=project)
    cmds = lambda *r: spark.createDataFrame(list(r), "entity_id string, command_id string, name string, body string, arrival long")
    first = runner.run(cmds(("a", "k1", "open", "100", 1), ("a", "k2", "add", "25", 2), ("a", "k2", "add", "25", 3), ("b", "k3", "open", "1", 1)))
    assert rows(first, "entity_id", "arrival", "status") == [("a", 1, "accepted"), ("a", 2, "accepted"), ("a", 3, "duplicate"), ("b", 1, "accepted")]
    assert rows(store.read("events"), "event_id") == [("a:1",), ("a:2",), ("a:3",), ("b:1",)]
    assert rows(store.read("snapshots"), "entity_id", "event_sequence", "payload") == [("a", 3, '{"opened": true, "sum": 126}')]
    again = runner.run(cmds(("a", "k9", "open", "1", 1), ("a", "k4", "add", "4", 2)))
    assert rows(again, "arrival", "status", "error") == [(1, "rejected", "Conflict: open"), (2, "accepted", None)]
    assert rows(store.read("events").where("entity_id = 'a' and sequence > 3"), "sequence", "payload") == [(4, "4"), (5, "1")]
    assert views.get(store.read("views"), "bank#a").first().payload == '{"state":"{\\"opened\\": true, \\"sum\\": 131}"}'
    assert rows(runner.run(cmds(("b", "k3", "open", "1", 1))), "status") == [("duplicate",)]


def test_write_sets(spark):
    from tidelog.sources.writes import Transaction, WriteSet

    a, b = WriteSet("views", spark.range(2)), WriteSet("views", spark.range(3))
    both = Transaction([a]).merge(Transaction([b])).merge(None).add(None).add(WriteSet("heads", spark.range(1)))
    assert both.by_table()[("views", "put")].rows.count() == 5 and len(both.groups) == 3
    assert a.merge(None) is a
    with pytest.raises(ValueError):
        a.merge(WriteSet("heads", spark.range(1)))


def test_layers(spark, rows, tmp_path):
    from tidelog.operators.layers import layers

    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("e", "f"), ("f", "e"), ("f", "g"), ("zz", "a")], "src string, dst string")
    assert rows(layers(nodes, edges)) == [("a", 0), ("b", 1), ("c", 2), ("d", 0), ("e", None), ("f", None), ("g", None)]


@pytest.mark.parametrize("local", [2_000_000, 1205, 4])
def test_layers_of_long_paths(spark, rows, tmp_path, local):
    """As a whole, part by part, and in parts of which some are beyond what a task takes."""
    from tidelog.operators.layers import layers

    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    most = 1200 if local > 4 else 7
    edges = [(f"a{i}", f"a{i + 1}") for i in range(most)] + [(f"b{i}", f"b{i + 2}") for i in range(4)] + [("c1", "c2"), ("c2", "c1"), ("c2", "c3"), ("d", "d"), (f"a{most}", "a+"), ("a0", "a+")]
    want = {f"a{i}": i for i in range(most + 1)} | {f"b{i}": i // 2 for i in range(6)} | {"c1": None, "c2": None, "c3": None, "d": None, "e": 0, "a+": most + 1}
    got = layers(spark.createDataFrame([(x,) for x in want], "node string"), spark.createDataFrame(edges, "src string, dst string"), local)
    assert dict(rows(got)) == want


def test_layers_of_a_large_cycle(spark, rows, tmp_path):
    from tidelog.operators.layers import layers

    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(i, (i + 1) % 6) for i in range(6)] + [(8, 7), (7, 0)], "src long, dst long")
    got = layers(spark.range(9).select(F.col("id").alias("node")), edges, 2)
    assert rows(got) == [(i, None) for i in range(6)] + [(6, 0), (7, 1), (8, 0)]


def test_handler_takes_the_budgets_in_turn(spark, rows):
    """Ingress before publishing (malformed records too), retries only for what failed; skipped and ignored records take none."""
    from tidelog.streaming import publish as P

    data = [(i, k, "a", i) for i, k in enumerate(["skipped", "ready", "malformed", "ready", "ready", "ignored"])]
    df = spark.createDataFrame(data, "n long, kind string, lane string, at long").withColumns({"ts": F.timestamp_seconds("at"), "key": F.col("n").cast("string"), "item_id": F.col("n").cast("string"), "group_id": F.lit(None).cast("string"), "dedup_id": F.lit(None).cast("string")})
    fail = lambda ready: ready.where("n = 1")
    got = rows(P.handle(df, fail, lane="lane", ingress=3, retries=1), "n", "status")
    assert got == [(0, "skipped"), (1, "failed"), (2, "malformed"), (3, "published"), (4, "throttled"), (5, "ignored")]
    every = lambda ready: ready
    got = rows(P.handle(df, every, lane="lane", ingress=0, retries=1), "n", "status")
    assert got == [(0, "skipped"), (1, "failed"), (2, "malformed"), (3, "dropped"), (4, "dropped"), (5, "ignored")]


def test_a_guard_that_cannot_be_read_or_written(spark, tmp_path, rows):
    from tidelog.sources.store import Store
    from tidelog.streaming import consume

    store = Store(spark, f"file://{tmp_path}/g").ensure()
    store.mark_processed(spark.createDataFrame([("p", "1")], "projector string, event_id string"))
    for folder in store.manifest()[1]["processed"]:
        store._fs.delete(store._path(folder), True)
    seen = []
    records = spark.createDataFrame([("1",), ("2",)], "event_id string")
    failed = consume.process(store, "p", lambda df: seen.extend(rows(df)), records)
    assert seen == [("1",), ("2",)] and failed.isEmpty()
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|late"):  # a projector's own failure is not the guard's
        consume.process(store, "p", lambda df: df.where(F.expr("1 / (cast(event_id as int) - 1) > 0")), records).collect()


@pytest.fixture()
def coalesced(spark):
    """A session that joins by shuffles and puts small partitions together by size, as larger tables have it."""
    session = spark.newSession()
    for name, value in {"shuffle.partitions": 12, "autoBroadcastJoinThreshold": -1, "adaptive.autoBroadcastJoinThreshold": -1, "adaptive.coalescePartitions.parallelismFirst": "false", "adaptive.advisoryPartitionSizeInBytes": "16k", "adaptive.coalescePartitions.minPartitionSize": "1k"}.items():
        session.conf.set(f"spark.sql.{name}", str(value))
    return session


def _numbered(session, path, per: int):
    """1,000 entities with ``per`` rows each, dealt out by entity by a window as the driver's logs are."""
    session.range(1000 * per).select(F.concat(F.lit("e"), (F.col("id") % 1000).cast("string")).alias("entity_id"), "id").write.parquet(path)
    by = Window.partitionBy("entity_id").orderBy("id")
    return session.read.parquet(path).withColumn("at", F.row_number().over(by).cast("long"))


def test_commands_meet_the_events_of_their_entity(coalesced, tmp_path):
    """The sides of the union are dealt out by entity already, and of different sizes."""
    old, new = _numbered(coalesced, f"{tmp_path}/old", 1), _numbered(coalesced, f"{tmp_path}/new", 12)
    log = old.select("entity_id", F.col("at").alias("sequence"), F.lit("opened").alias("type"), F.lit("5").alias("payload"), F.lit("k").alias("command_id"))
    cmds = new.select("entity_id", F.lit(None).cast("string").alias("command_id"), F.lit("add").alias("name"), F.lit("1").alias("body"), F.col("at").alias("arrival"))
    made = commands.execute(log, cmds, *account()).select("entity_id", F.explode("events.sequence").alias("n")).groupBy("entity_id")
    assert made.agg(F.min("n").alias("least"), F.max("n").alias("most")).groupBy("least", "most").count().collect() == [(2, 25, 1000)]


def test_events_meet_the_snapshot_of_their_entity(coalesced, tmp_path):
    from tidelog.operators.fold import fold_python

    old, new = _numbered(coalesced, f"{tmp_path}/old", 1), _numbered(coalesced, f"{tmp_path}/new", 12)
    both = old.select("entity_id", (F.col("at") - 1).alias("sequence")).unionByName(new.select("entity_id", F.col("at").alias("sequence")))
    got = fold_python(both, [], lambda _: {"n": 0}, lambda state, event: {"n": state["n"] + 1}, "n long")
    assert got.groupBy("n").count().collect() == [(13, 1000)]
