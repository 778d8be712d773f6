import pytest
from pyspark.sql import functions as F

from tidelog.functions.errors import Conflict
from tidelog.sources import store as ST

EV = "entity_id string, sequence long, type string, entity_type string, commit_id string"


@pytest.fixture()
def store(spark, tmp_path):
    return ST.Store(spark, f"file://{tmp_path}/s").ensure()


def events(spark, *seqs, entity="a", commit="c"):
    return spark.createDataFrame([(entity, s, "t", "x", commit) for s in seqs], EV)


def test_append_and_conflict(spark, store, rows):
    store.commit(events(spark, 1, 2))
    with pytest.raises(Conflict) as e:
        store.commit(events(spark, 3, 2))
    assert e.value.keys == [("a", 2)]
    with pytest.raises(Conflict):
        store.commit(events(spark, 5, 5))
    assert rows(store.read("events"), "sequence") == [(1,), (2,)]
    store.commit(events(spark, 1, entity="b"))
    assert store.read("events").count() == 3


def test_all_tables_of_a_commit_appear_together(spark, store, rows):
    snap = spark.createDataFrame([("a", "x", 1, 2, "{}")], "entity_id string, entity_type string, sequence long, event_sequence long, payload string")
    view = spark.createDataFrame([("x#a", "", "a", "x", "{}")], "pk string, sk string, entity_id string, entity_type string, payload string")
    before = store.version()
    at = store.commit(events(spark, 1, 2), snap, view)
    assert at == before + 1
    assert (store.read("snapshots").count(), store.read("views").first().sk) == (1, "VIEW")
    assert store.read("events", before).isEmpty() and store.read("views", before).isEmpty()


def test_empty_commits(spark, store):
    at = store.version()
    assert store.commit(events(spark, 1).limit(0)) == at
    with pytest.raises(ValueError):
        store.commit(events(spark, 1).limit(0), snapshot=events(spark, 1))


def test_a_lost_race_is_tried_again(spark, store, rows):
    other = ST.Store(spark, store.path)
    folder = other._write("events", events(spark, 9, entity="z"))
    raced = []

    def change(at, live):
        if not raced:  # another writer publishes between the check and the create
            raced.append(at)
            other.transact(lambda _, now: now | {"events": [*now["events"], folder]})
        return live | {"events": [*live["events"], store._write("events", events(spark, 1))]}

    store.transact(change)
    assert rows(store.read("events"), "entity_id") == [("a",), ("z",)]


def test_commit_stream_rejects_whole_commits(spark, store, rows):
    store.commit(events(spark, 1))
    batch = spark.createDataFrame(
        [("a", 1, "c1", 1), ("a", 2, "c1", 1), ("a", 2, "c2", 2), ("a", 3, "c2", 2), ("a", 3, "c3", 3), ("b", 1, "c4", 4), ("b", 1, "c5", 5), ("b", 2, "c6", 6), ("b", 2, "c6", 6)],
        "entity_id string, sequence long, commit_id string, arrival long",
    ).withColumns({"type": F.lit("t"), "entity_type": F.lit("x")})
    got = store.commit_stream(batch)
    assert rows(got, "commit_id", "accepted") == [("c1", False), ("c2", True), ("c3", False), ("c4", True), ("c5", False), ("c6", False)]
    assert rows(store.read("events"), "entity_id", "sequence") == [("a", 1), ("a", 2), ("a", 3), ("b", 1)]


def test_snapshots_never_go_back(spark, store):
    put = lambda seq, p: store.put_snapshots(spark.createDataFrame([("a", "x", 1, seq, p)], "entity_id string, entity_type string, sequence long, event_sequence long, payload string"))
    put(5, "five")
    put(3, "three")
    assert store.read("snapshots").first().payload == "five"
    put(5, "again")
    assert store.read("snapshots").first().payload == "again"


def test_compaction_in_the_store(spark, store, rows):
    store.commit(events(spark, *range(1, 8)))
    store.put_snapshots(spark.createDataFrame([("a", "x", 1, 5)], "entity_id string, entity_type string, sequence long, event_sequence long"))
    req = spark.createDataFrame([("a", 5)], "entity_id string, through long")
    assert store.compact(req).first().deleted == 5
    assert store.compact(req).first().deleted == 0
    assert rows(store.read("events"), "sequence") == [(6,), (7,)]


def test_maintenance(spark, store, rows):
    store.commit(events(spark, 1, 2))
    with pytest.raises(PermissionError):
        store.delete_events(events(spark, 1))
    store.delete_events(events(spark, 1), unsafe=True)
    store.rewrite("events", 1)
    assert rows(store.read("events"), "sequence") == [(2,)]
    store.mark_processed(spark.createDataFrame([("p", "e")], "projector string, event_id string"))
    store.mark_processed(spark.createDataFrame([("p", "e"), ("q", "e")], "projector string, event_id string"))
    assert store.read("processed").count() == 2
    assert store.status()["tables"]["events"]["key"] == ["entity_id", "sequence"]


def test_names_and_missing_store(spark, tmp_path):
    with pytest.raises(ValueError):
        ST.Store(spark, str(tmp_path), {"bad name": None})
    with pytest.raises(FileNotFoundError):
        ST.Store(spark, f"file://{tmp_path}/none").manifest()


def test_deltas_are_merged_and_folded(spark, store, rows, monkeypatch):
    monkeypatch.setattr(ST, "MERGE_AT", 3)
    view = lambda *r: spark.createDataFrame([(pk, "", pk, "t", p, None, n) for n, (pk, p) in enumerate(r)], "pk string, sk string, entity_id string, entity_type string, payload string, ttl long, arrival long")
    want = {}
    for i in range(8):
        put = [("a", f"a{i}"), (f"k{i}", "x"), ("a", f"A{i}")]
        store.put_views(view(*put))
        want.update(put)
        if i % 3 == 1:
            store.delete_views(spark.createDataFrame([(f"k{i}", None), ("none", None)], "pk string, sk string"))
            want.pop(f"k{i}")
        assert {r.pk: r.payload for r in store.read("views").collect()} == want
        assert len(store.manifest()[1]["views"]) <= 3
    store.rewrite("views", 2)
    assert {r.pk: r.payload for r in store.read("views").collect()} == want
    head = lambda *r: spark.createDataFrame(list(r), "entity_id string, entity_type string, head_seq long")
    for h in ([("a", "x", 5)], [("a", "y", 5), ("b", "y", 0)], [("a", "z", 3)], [("c", "x", 1)], [("c", "w", 2)]):
        store.put_heads(head(*h))
    assert rows(store.read("heads")) == [("a", "x", 5), ("c", "w", 2)]
    store.put_checkpoints(head(("a", "x", 5)))
    store.put_checkpoints(head(("a", "x", 2), ("c", "x", 2)))
    assert rows(store.read("checkpoints")) == [("a", 5), ("c", 2)]


def test_a_writer_that_dies_leaves_the_store_whole(spark, store, rows, monkeypatch):
    """Death before the manifest has its name, and an empty manifest as an older writer may have left it."""
    store.commit(events(spark, 1))
    at = store.version()

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(ST.Store, "_exclusive", staticmethod(dies))
    with pytest.raises(KeyboardInterrupt):
        ST.Store(spark, store.path).commit(events(spark, 2))
    monkeypatch.undo()
    assert store.version() == at and rows(store.read("events"), "sequence") == [(1,)]
    store._fs.create(store._path(f"{store.path}/_log/{at + 1:020d}.json"), False).close()
    assert store.version() == at and rows(ST.Store(spark, store.path).ensure().read("events"), "sequence") == [(1,)]
    store.commit(events(spark, 3))
    assert rows(store.read("events"), "sequence") == [(1,), (3,)] and store.version() == at + 2
    with pytest.raises(Conflict):
        store.commit(events(spark, 3))
    with pytest.raises(ST.Lost):
        store._publish(at + 2, {})


def test_removing_events_rewrites_only_their_files(spark, store, rows):
    for name in "abc":
        store.commit(events(spark, *range(1, 8), entity=name).coalesce(1))
    snap = spark.createDataFrame([("b", "x", 1, 5)], "entity_id string, entity_type string, sequence long, event_sequence long")
    store.put_snapshots(snap)
    before = set(store.read("events").inputFiles())
    done = store.compact(spark.createDataFrame([("b", 5), ("a", 3)], "entity_id string, through long"))
    assert rows(done, "entity_id", "status", "deleted") == [("a", "uncovered", 0), ("b", "ok", 5)]
    after = set(store.read("events").inputFiles())
    assert len(before & after) == 2 and rows(store.read("events").where("entity_id = 'b'"), "sequence") == [(6,), (7,)]
    at = store.version()
    assert store.compact(spark.createDataFrame([("b", 5)], "entity_id string, through long")).first().deleted == 0
    assert store.version() == at  # nothing to delete, nothing written
    store.delete_events(spark.createDataFrame([("c", 7)], "entity_id string, sequence long"), unsafe=True)
    assert len(set(store.read("events").inputFiles()) & before) == 1 and store.read("events").count() == 15
    store.commit(events(spark, 8, entity="c"))
    assert store.read("events").count() == 16


def test_expiry_in_the_store(spark, store, rows):
    ev = lambda *r: spark.createDataFrame([(e, s, "t", "x", "c", ttl) for e, s, ttl in r], EV + ", ttl long").coalesce(1)
    store.commit(ev(("a", 1, 10), ("a", 2, None)))
    store.commit(ev(("b", 1, 100), ("b", 2, None)))
    store.put_views(spark.createDataFrame([("p", "", "p", "t", "old", 10), ("q", "", "q", "t", "new", 100)], "pk string, sk string, entity_id string, entity_type string, payload string, ttl long"))
    store.put_snapshots(spark.createDataFrame([("a", "x", 1, 2, 10), ("b", "x", 1, 2, None)], "entity_id string, entity_type string, sequence long, event_sequence long, ttl long"))
    before = set(store.read("events").inputFiles())
    at = store.expire(10)
    assert rows(store.read("events"), "entity_id", "sequence") == [("a", 2), ("b", 1), ("b", 2)]
    assert len(set(store.read("events").inputFiles()) & before) == 1
    assert rows(store.read("views"), "pk") == [("q",)] and rows(store.read("snapshots"), "entity_id") == [("b",)]
    assert store.expire(10) == at
    store.put_snapshots(spark.createDataFrame([("a", "x", 1, 1)], "entity_id string, entity_type string, sequence long, event_sequence long"))
    assert store.read("snapshots").count() == 2


def test_small_commits_are_folded(spark, store, rows, monkeypatch):
    monkeypatch.setattr(ST, "FOLD_AT", 4)
    for i in range(10):
        store.commit(events(spark, i + 1))
        assert len(store.manifest()[1]["events"]) <= 4
    assert rows(store.read("events"), "sequence") == [(i + 1,) for i in range(10)]
    with pytest.raises(Conflict):
        store.commit(events(spark, 4))


def test_commit_stream_decides_again_after_a_race(spark, store, rows, monkeypatch):
    """Another writer takes a sequence between the decision and the commit: only what it took is rejected."""
    offered = spark.createDataFrame([("a", 1, "c1", 1), ("b", 1, "c2", 2), ("c", 1, "c3", 3)], "entity_id string, sequence long, commit_id string, arrival long").withColumns({"type": F.lit("t"), "entity_type": F.lit("x")})
    other, publish, raced = ST.Store(spark, store.path), ST.Store._publish, []

    def late(self, version, live):
        if self is store and not raced:
            raced.append(1)
            other.commit(events(spark, 1, entity="b"))
        return publish(self, version, live)

    monkeypatch.setattr(ST.Store, "_publish", late)
    got = store.commit_stream(offered)
    assert raced and rows(got, "commit_id", "accepted") == [("c1", True), ("c2", False), ("c3", True)]
    assert rows(store.read("events"), "entity_id", "sequence", "commit_id") == [("a", 1, "c1"), ("b", 1, "c"), ("c", 1, "c3")]
    assert not any(r.accepted for r in store.commit_stream(offered).collect()) and store.read("events").count() == 3


def test_commits_without_a_name_are_commits(spark):
    offered = spark.createDataFrame([("a", 1, "", 1), ("a", 1, "x", 2)], "entity_id string, sequence long, commit_id string, arrival long")
    none = offered.limit(0)
    assert sorted((r.commit_id, r.accepted) for r in ST.accept(offered, none).collect()) == [("", True), ("x", False)]
    assert not any(r.accepted for r in ST.accept(offered, offered.where("arrival = 1")).collect())
