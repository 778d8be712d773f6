import pytest
from pyspark.sql import functions as F

from tidelog.functions.columns import to_json
from tidelog.operators import evolve, rebuild, views

V = "pk string, sk string, entity_id string, entity_type string, payload string, ttl long"


@pytest.fixture()
def table(spark):
    return spark.createDataFrame([(f"t#{i}", "VIEW", str(i), "t", f'{{"n":{i}}}', None) for i in range(5)] + [("u#1", "A", "1", "u", "{}", 9)], V)


def test_upsert_delete_get(spark, table, rows):
    new = spark.createDataFrame([("t#1", "", "1", "t", "first", None, 1), ("t#1", "VIEW", "1", "t", "last", 3, 2), (None, "x", "1", "t", "none", None, 1), ("n", "K", "1", "t", "new", None, 1)], V + ", arrival long")
    got = views.upsert(table, new)
    assert got.count() == 7
    assert (views.get(got, "t#1").first().payload, views.get(got, "t#1").first().ttl) == ("last", 3)
    assert views.get(got, "u#1").isEmpty() and views.get(got, "none").isEmpty()
    assert views.delete(got, spark.createDataFrame([("t#1", None), ("u#1", "A")], "pk string, sk string")).count() == 5


def test_batch_get_skips_blanks(spark, table, rows):
    keys = spark.createDataFrame([("t#1",), ("t#1",), ("",), (None,), ("zz",), ("u#1",)], "pk string")
    assert rows(views.batch_get(table, keys), "pk") == [("t#1",)]


def test_paging(table):
    seen, after = [], None
    for _ in range(10):
        page, after = views.page(table, 4, after)
        seen += [(r.pk, r.sk) for r in page.collect()]
        if not after:
            break
    assert seen == sorted(seen) and len(seen) == 6
    assert views.page(table, 0)[0].count() == 6
    for bad in ("%%%", "AAAA", "e30="):
        with pytest.raises(views.BadCursor):
            views.page(table, 2, bad)


def test_codec(spark, rows):
    df = spark.createDataFrame([("a", "VIEW", "a", "t", '{"n":1}', None), ("b", "VIEW", "b", "t", '{"n":"x"}', None), ("c", "VIEW", "c", "t", "{", None), ("d", "VIEW", "d", "t", None, None)], V)
    assert rows(views.decode_valid(df, "n bigint").select("pk", "value.n")) == [("a", 1)]
    assert rows(views.decode_errors(df, "n bigint"), "pk") == [("b",), ("c",), ("d",)]
    with pytest.raises(Exception, match="undecodable view"):
        views.decode_strict(df, "n bigint").collect()


def test_view_store(spark, rows):
    store = views.ViewStore(views.ViewStore.empty(spark), "t", "id string, n bigint")
    store.put(spark.createDataFrame([("a", 1), ("b", 2)], "id string, n long"), "id")
    store.put(spark.createDataFrame([("a", 5)], "id string, n long"), "id")
    assert store.get("t#a").n == 5 and store.get("t#none") is None
    bad = []
    store.views = store.views.unionByName(spark.createDataFrame([("t#z", "VIEW", "z", "t", "[", None)], V))
    assert rows(store.list(lambda r: bad.append(r.pk)), "id", "n") == [("a", 5), ("b", 2)] and bad == ["t#z"]
    assert store.page(2)[1]


def test_upcast_in_declared_order(spark, rows):
    log = spark.createDataFrame([("a", 1, "t", 1, "{}"), ("a", 2, "t", 2, "{}"), ("a", 3, "u", 1, "{}"), ("a", 4, "bad", 1, "{}")], "entity_id string, sequence long, type string, version long, payload string")
    up = [evolve.Upcaster("t", 1, lambda p: F.lit('{"v":2}'), 2), evolve.Upcaster("t", 2, lambda p: F.lit('{"v":3}'), 3), evolve.Upcaster("bad", 1, lambda p: F.lit(None).cast("string"), 2)]
    got = rows(evolve.upcast(log, up), "sequence", "version", "payload", "failed_phase")
    assert got == [(1, 3, '{"v":3}', None), (2, 3, '{"v":3}', None), (3, 1, "{}", None), (4, 1, "{}", "upcast")]
    back = rows(evolve.upcast(log, up[:2][::-1]), "sequence", "version")
    assert back == [(1, 2), (2, 3), (3, 1), (4, 1)]


def test_strict_decode_fails_closed(spark, rows):
    log = spark.createDataFrame([("a", 1, "t", 1, '{"n":1}'), ("a", 2, "t", 1, '{"n":"x"}'), ("a", 3, "??", 1, "{}"), ("a", 4, "t", 1, "{"), ("a", 5, "t", 1, None)], "entity_id string, sequence long, type string, version long, payload string")
    got = evolve.strict_decode(log, {"t": "n bigint"})
    assert rows(got, "sequence", "data.t.n", "error.phase") == [(1, 1, None), (2, None, "deserialize"), (3, None, "deserialize"), (4, None, "deserialize"), (5, None, "deserialize")]
    with pytest.raises(Exception, match="replay failed closed"):
        evolve.strict_decode(log, {"t": "n bigint"}, fail=True).select("error").collect()


def test_invalid_metadata(spark):
    df = spark.createDataFrame([(None,), (" ",), ("{",), ("{}",)], "m string").select(evolve.invalid_reason(F.col("m")).alias("r"))
    assert [r.r for r in df.collect()] == ["missing", "missing", "invalid_json", None]


STATES = [("a", "t", None, 1), ("b", "t", "boom", 1), ("c", "u", None, 1), (None, "t", None, 1), ("d", "t", None, 2)]


def test_rebuild(spark, rows):
    states = spark.createDataFrame(STATES, "entity_id string, entity_type string, error string, n long")
    out, progress = [], []
    got = rebuild.run(states, [lambda s: views.project(s, "n")], lambda v: out.extend(rows(v, "pk", "payload")), "t", on_progress=lambda p, e: progress.append((p, e)))
    assert (got.processed, got.skipped, got.errors) == (2, 2, ["entity b: boom"])
    assert out == [("t#a", '{"n":1}'), ("t#d", '{"n":2}')] and len(progress) == 3 and progress[-1] == (2, 1)
    assert rows(rebuild.summary_of(states, "t")) == [(2, 2, 1)]


def test_rebuild_projector_errors_and_limits(spark, rows):
    states = spark.createDataFrame(STATES, "entity_id string, entity_type string, error string, n long")
    fail = lambda s: views.project(s, "n").withColumn("error", F.when(F.col("entity_id") == "d", "no"))
    out = []
    got = rebuild.run(states, [fail], lambda v: out.extend(rows(v, "pk")), "t")
    assert (got.processed, got.errors, out) == (1, ["entity b: boom", "entity d: no"], [("t#a",)])
    with pytest.raises(RuntimeError, match=r"rebuild stopped: reached MaxErrors limit \(2\)"):
        rebuild.run(states, [fail], out.append, "t", max_errors=2)
    assert rebuild.run(states, [fail], entity_type="t", dry_run=True).processed == 1
    for bad in ({"projectors": []}, {"projectors": [fail]}):
        with pytest.raises(ValueError):
            rebuild.run(states, **bad)


def test_json_of_struct(spark):
    assert spark.range(1).select(to_json(F.struct(F.lit("a").alias("x")))).first()[0] == '{"x":"a"}'


def test_rebuild_by_query_checks_its_arguments(spark):
    states = spark.createDataFrame(STATES, "entity_id string, entity_type string, error string, n long")
    for bad in ({"seed": 1}, {"enumerate_type": "u"}):
        with pytest.raises(ValueError):
            rebuild.by_query(states, [lambda s: s], entity_type="t", dry_run=True, **bad)
    assert rebuild.by_query(states, [lambda s: views.project(s, "n")], entity_type="t", enumerate_type="t", dry_run=True).processed == 2


def test_a_rebuild_gives_all_errors(spark):
    states = spark.range(2500).select(F.format_string("e%04d", "id").alias("entity_id"), F.lit("t").alias("entity_type"), F.when(F.col("id") >= 1, "boom").alias("error"), F.lit(1).alias("n"))
    project = [lambda s: views.project(s, "n")]
    done = rebuild.run(states, project, entity_type="t", dry_run=True)
    assert (done.processed, done.errors) == (1, [f"entity e{i:04d}: boom" for i in range(1, 2500)])
    with pytest.raises(RuntimeError) as stopped:
        rebuild.run(states, project, entity_type="t", dry_run=True, max_errors=1200)
    assert stopped.value.summary.errors == done.errors[:1200]
