import pytest
from pyspark.sql import functions as F

from tidelog.operators import heads, maintenance, snapshots

LOG = "entity_id string, entity_type string, sequence long"
SNAP = "entity_id string, entity_type string, event_sequence long"


@pytest.mark.parametrize(("cur", "n", "most", "want"), [(0, 2, 5, 0), (0, 5, 5, 5), (3, 3, 5, 3), (0, 12, 5, 12), (2, 20, 5, 20), (0, 100, 0, 0)])
def test_decision(spark, cur, n, most, want):
    assert spark.range(1).select(snapshots.decision(F.lit(cur), F.lit(n), F.lit(most))).first()[0] == want


def test_heads(spark, rows):
    log = spark.createDataFrame([("w1", "widget", 1), ("w1", "widget", 3), ("w1", "widget", 2), ("w2", "widget", 1), ("g1", "gadget", 4)], LOG)
    snaps = spark.createDataFrame([("w2", "widget", 7), ("w1", "widget", 2), ("w3", "widget", 9)], SNAP)
    assert rows(heads.heads(log, snaps), "entity_id", "head_seq") == [("g1", 4), ("w1", 3), ("w2", 7), ("w3", 9)]
    assert rows(heads.heads(log, snaps, "gadget"), "entity_id", "head_seq") == [("g1", 4)]


def test_heads_only_rise(spark, rows):
    head = lambda *r: spark.createDataFrame(list(r), "entity_id string, entity_type string, head_seq long")
    current = head(("a", "x", 5), ("b", "x", 1))
    got = heads.merge(current, head(("a", "y", 5), ("a", "z", 3), ("b", "y", 2), ("", "x", 9), ("c", "x", 0)))
    assert rows(got) == [("a", "x", 5), ("b", "y", 2)]


def test_changed_and_advanced(spark, rows):
    h = spark.createDataFrame([("a", "x", 3), ("b", "x", 3), ("c", "x", 1)], "entity_id string, entity_type string, head_seq long")
    c = spark.createDataFrame([("a", 3), ("b", 2)], "entity_id string, checkpoint long")
    assert rows(heads.changed(h, c), "entity_id", "checkpoint") == [("b", 2), ("c", 0)]
    assert rows(heads.advance(c, h)) == [("a", 3), ("b", 3), ("c", 1)]


def test_visit_stops(spark):
    h = spark.createDataFrame([(str(i), "x", i) for i in range(1, 20)], "entity_id string, entity_type string, head_seq long")
    seen = []
    assert heads.visit(h, lambda r: seen.append(r) or len(seen) < 5) == 5


def commits(spark, sizes):
    data, at = [], 0
    for i, n in enumerate(sizes):
        data += [("e", "x", at + j + 1, f"c{i}") for j in range(n)]
        at += n
    return spark.createDataFrame(data, LOG + ", commit_id string")


@pytest.mark.parametrize(("sizes", "every", "want"), [([3, 2], 2, (2, 5)), ([10], 5, (1, 10)), ([1, 1], 5, None)])
def test_floors(spark, sizes, every, want):
    got = snapshots.floors(commits(spark, sizes), every).collect()
    assert [(r.sequence, r.event_sequence) for r in got] == ([want] if want else [])


def test_upsert_is_monotonic(spark, rows):
    cur = spark.createDataFrame([("a", 5, "old"), ("b", 5, "old"), ("c", 5, "old")], "entity_id string, event_sequence long, payload string")
    new = spark.createDataFrame([("a", 4, "low", 1), ("b", 5, "same", 1), ("c", 6, "up", 1), ("c", 6, "later", 2), ("d", 1, "new", 1)], "entity_id string, event_sequence long, payload string, arrival long")
    assert rows(snapshots.upsert(cur, new)) == [("a", 5, "old"), ("b", 5, "same"), ("c", 6, "later"), ("d", 1, "new")]


def test_freshness_and_catch_up(spark, rows):
    log = spark.createDataFrame([("a", "x", i) for i in range(1, 8)] + [("b", "x", 1)], LOG)
    snaps = spark.createDataFrame([("a", "x", 5), ("s", "x", 9)], SNAP).withColumn("sequence", F.lit(2).cast("long"))
    debts = snapshots.freshness(log, snaps, budget=1)
    assert rows(debts) == [("a", 7, 5, 2, 16, True), ("b", 1, 0, 1, 8, False), ("s", 9, 9, 0, 0, False)]
    states = spark.createDataFrame([("a", "x", 7, "{}"), ("b", "x", 1, "{}")], "entity_id string, entity_type string, head_seq long, payload string")
    assert rows(snapshots.catch_up(states, snaps, debts, 2), "entity_id", "sequence", "event_sequence") == [("a", 3, 7)]
    assert snapshots.catch_up(states, snaps, debts, 0).isEmpty()


def test_compaction(spark, rows):
    log = spark.createDataFrame([("a", "x", i) for i in range(1, 8)] + [("b", "x", i) for i in range(1, 4)], LOG)
    snaps = spark.createDataFrame([("a", "x", 5)], SNAP)
    req = lambda *r: spark.createDataFrame(list(r), "entity_id string, through long")
    assert rows(maintenance.compaction_counts(log, req(("a", 5), ("a", 6), ("a", 0), ("b", 2)), snaps)) == [("a", 0, "noop", 0), ("a", 5, "ok", 5), ("a", 6, "uncovered", 0), ("b", 2, "uncovered", 0)]
    left = maintenance.compact(log, req(("a", 5), ("b", 2)), snaps)
    assert rows(left.where("entity_id = 'a'"), "sequence") == [(6,), (7,)] and left.count() == 5
    assert maintenance.compaction_counts(left, req(("a", 5)), snaps).first().deleted == 0


def test_retention_and_gaps(spark, rows):
    log = spark.createDataFrame([("a", "x", 1), ("a", "x", 2), ("a", "x", 5), ("b", "x", 4)], LOG)
    assert rows(maintenance.gaps(log)) == [("a", 2, 5), ("b", 0, 4)]
    assert rows(maintenance.gappy(log)) == [("a", 2), ("b", 3)]
    assert rows(maintenance.gaps(log, spark.createDataFrame([("b", "x", 3)], SNAP))) == [("a", 2, 5)]
    t = log.withColumn("ttl", maintenance.ttl(F.col("entity_id"), {"a": 10, "b": 0}, F.lit("1970-01-01 00:01:00").cast("timestamp")))
    assert rows(t, "entity_id", "ttl") == [("a", 70), ("a", 70), ("a", 70), ("b", None)]
    assert rows(maintenance.expire(t, 70), "entity_id") == [("b",)]
