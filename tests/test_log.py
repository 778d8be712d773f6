import pytest
from pyspark.sql import functions as F

from tidelog.functions import columns as C
from tidelog.functions import schemas as S
from tidelog.sources import log as L

LOG = "entity_id string, sequence long, type string, entity_type string"


@pytest.fixture()
def log(spark):
    return spark.createDataFrame([("a", 2, "u", "x"), ("b", 1, "c", "y"), ("a", 1, "c", "x"), ("b", 3, "u", "y"), ("b", 2, "u", "y"), ("a", 3, "u", "x")], LOG)


def test_scans_honour_the_type_filter(log, rows):
    assert len(rows(L.scan(log))) == 6
    assert rows(L.scan(log, "x"), "sequence") == [(1,), (2,), (3,)]
    assert L.scan(log, "none").isEmpty()


def test_point_and_tail_reads(log, rows):
    assert [r.sequence for r in L.events_of(log, "b").collect()] == [1, 2, 3]
    assert [r.sequence for r in L.latest_events(log, "b", 1).collect()] == [2, 3]
    assert L.events_of(log, "none").isEmpty()
    assert L.max_sequence(log, "b").first()[0] == 3
    assert L.max_sequence(log, "none").first()[0] == 0


def test_ids_count_snapshots(spark, log, rows):
    snaps = spark.createDataFrame([("s", "x", 7)], "entity_id string, entity_type string, event_sequence long")
    assert rows(L.entity_ids(log, snaps)) == [("a",), ("b",), ("s",)]
    assert rows(L.entity_ids(log, snaps, "x")) == [("a",), ("s",)]


def test_registry_and_skip(spark, log, rows):
    heads = spark.createDataFrame([("a",), ("b",), ("gone",)], "entity_id string")
    assert rows(L.registered(log, heads, spark.createDataFrame([("a",)], "entity_id string")), "entity_id", "sequence") == [("b", 1), ("b", 2), ("b", 3)]


def items(spark, data):
    return spark.createDataFrame(data, S.ITEM)


def test_inline_snapshots_are_not_events(spark, rows):
    df = items(spark, [("a", 1, "t", 1, "x", "{}", '{"region":"r","commandId":"c"}', None, None, None), ("a", 0, None, None, "x", "{}", None, None, 2, 5)])
    event = L.decode_items(df).first()
    assert (event.event_id, event.metadata.region, event.metadata.command_id) == ("a:1", "r", "c")
    assert rows(L.decode_inline_snapshots(df), "entity_id", "sequence", "event_sequence") == [("a", 2, 5)]


def test_broken_metadata_stops_a_strict_scan(spark):
    df = items(spark, [("a", 1, "t", 1, "x", "{}", '{"region"', None, None, None)])
    with pytest.raises(Exception, match="unreadable metadata"):
        L.decode_items(df).collect()
    assert L.decode_items(df, strict=False).first().metadata is None


def test_envelopes_reject_missing_ids(spark):
    good = '{"id":"a:1","source":"s","detail-type":"t","detail":{"id":"a:1","sequence":1,"type":"t","version":1,"entityId":"a","entityType":"x","payload":"e30=","metadata":{"region":"r"}}}'
    data = [(good,), (good.replace('"entityId":"a"', '"entityId":""'),), (good.replace('"detail":{"id":"a:1"', '"detail":{"id":""'),), ("{",), ('{"id":"x"}',)]
    got = L.decode_envelopes(spark.createDataFrame(data, "message string")).collect()
    assert [r.reject for r in got] == [None, "event envelope has no entity id", "event envelope has no event id", "envelope is not JSON", "detail is not an event"]
    assert (got[0].payload, got[0].event_id, got[0].sequence) == ("{}", "a:1", 1)


def test_changes_only_inserts(spark, rows):
    image = ("a", 1, "t", 1, "x", "{}", "{}", None, None, None)
    data = [("r1", "INSERT", "1", image), ("r2", "MODIFY", "2", image), ("r3", "INSERT", "3", None), ("r4", "INSERT", "4", ("a", 0, None, None, "x", "{}", None, None, 1, 5))]
    df = spark.createDataFrame(data, S.CHANGE)
    assert rows(L.change_records(df), "event_id") == [("a:1",)]
    assert rows(L.change_records(df, id_from="record"), "event_id") == [("r1",)]


def test_codecs(spark):
    long = "x" * 200
    df = spark.createDataFrame([(long + "??>>",)], "t string").select("t", C.b64url(F.encode("t", "utf-8")).alias("b"), C.slug(F.lit("  Hello, World! ")).alias("s"))
    row = df.withColumn("back", C.unb64url(F.col("b")).cast("string")).first()
    assert row.back == row.t and "\n" not in row.b and "+" not in row.b and "/" not in row.b
    assert row.s == "hello-world"


def test_null_fields_are_written(spark):
    assert spark.range(1).select(C.to_json(F.struct(F.lit(None).cast("string").alias("a"), F.lit(1).alias("b")))).first()[0] == '{"a":null,"b":1}'


def test_metadata_builders(spark):
    m = C.metadata(region=F.lit("r"), timestamp=F.lit("2024-01-02 03:04:05").cast("timestamp"), command_id=F.lit("c"), address=F.lit(""))
    row = spark.range(1).select(m.alias("m"), C.metadata_to_json(m).alias("j")).first()
    assert row.m.timestamp == "2024-01-02T03:04:05Z" and row.m.address is None and row.m.origin is None
    assert row.j == '{"commandId":"c","trace":null,"origin":null,"address":null,"region":"r","timestamp":"2024-01-02T03:04:05Z"}'
