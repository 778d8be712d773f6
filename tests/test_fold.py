import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions.errors import BadEvent
from tidelog.operators import fold, heads, maintenance, snapshots
from tidelog.operators.fold import Reducer

BANK = "entity_id string, sequence long, type string, cents long, other string"


def fields():
    return {"balance": Reducer("sum", F.col("cents"), F.col("type") != "fake"), "n": Reducer("count"), "other": Reducer("last", F.col("other"))}


def bank(spark, data):
    return spark.createDataFrame(data, BANK)


def test_open_then_deposit(spark):
    log = bank(spark, [("a", 2, "deposit", 25, None), ("a", 1, "open", 100, "o")])
    row = fold.fold(log, fields()).first()
    assert (row.balance, row.n, row.head_seq) == (125, 2, 2)
    assert row.other is None  # a null overwrites


def step(state, e):
    return F.struct(F.when(e["type"] == "open", e["cents"]).otherwise(state["balance"] + e["cents"]).alias("balance"))



def start():
    return F.struct(F.lit(0).cast("long").alias("balance"))


def test_opening_resets(spark, rows):
    log = bank(spark, [("a", 1, "open", 100, None), ("a", 2, "deposit", 5, None), ("a", 3, "open", 7, None), ("a", 4, "deposit", 1, None), ("b", 1, "deposit", 3, None)])
    assert rows(fold.fold_ordered(log, ["type", "cents"], start(), step).select("entity_id", "head_seq", "state.balance")) == [("a", 4, 8), ("b", 1, 3)]


def test_python_fold_gives_errors_and_goes_on(spark, rows):
    def apply(state, e):  # local: a worker can't import this module
        if e["type"] == "fake":
            raise BadEvent("fake")
        return {"balance": int(e["cents"]) if e["type"] == "open" else state["balance"] + int(e["cents"])}

    log = bank(spark, [("a", 1, "open", 1, None), ("a", 2, "fake", 0, None), ("a", 3, "deposit", 1, None), ("b", 1, "open", 4, None)])
    got = rows(fold.fold_python(log, ["type", "cents"], lambda _: {"balance": 0}, apply, "balance bigint"))
    assert got == [("a", 1, 1, "BadEvent: Event not recognized: fake"), ("b", 1, 4, None)]


def test_no_state_no_entity(spark):
    log = bank(spark, [("a", 1, "open", 1, None)])
    assert fold.fold_python(log, [], lambda _: None, lambda s, e: None, "x bigint").isEmpty()


def made_log(spark, seed, shuffled=True):
    r = random.Random(seed)
    data = [(f"e{i}", s, r.choice(["open", "deposit"]), r.randrange(100), r.choice(["x", None])) for i in range(8) for s in range(1, r.randrange(2, 25))]
    if shuffled:
        r.shuffle(data)
    return bank(spark, data)


@pytest.mark.parametrize("seed", [1, 2])
def test_seeded_is_full_and_order_of_rows_is_nothing(spark, rows, seed):
    log = made_log(spark, seed).withColumn("commit_id", F.floor((F.col("sequence") - 1) / 3).cast("string")).withColumn("entity_type", F.lit("t"))
    floors = snapshots.floors(log).select("entity_id", "event_sequence")
    covered = log.join(floors, "entity_id").where("sequence <= event_sequence")
    seeds = floors.join(fold.fold(covered, fields()).drop("head_seq"), "entity_id")
    full = rows(fold.fold(log, fields()))
    assert rows(fold.fold_seeded(log, seeds, fields())) == full
    assert rows(fold.fold(made_log(spark, seed, False), fields())) == full
    left = maintenance.compact(log, floors.withColumnRenamed("event_sequence", "through"), floors)
    assert left.count() < log.count()
    assert rows(fold.fold_seeded(left, seeds, fields())) == full
    ordered = rows(fold.fold_ordered(log, ["type", "cents"], start(), step).select("entity_id", "head_seq", "state.balance"))
    states = floors.join(fold.fold_ordered(covered, ["type", "cents"], start(), step).select("entity_id", "state"), "entity_id")
    assert rows(fold.fold_ordered(left, ["type", "cents"], start(), step, seeds=states).select("entity_id", "head_seq", "state.balance")) == ordered
    assert rows(heads.heads(left, snapshots.floors(log))) == rows(heads.heads(log))


def test_snapshot_only_entities_survive(spark, rows):
    log = bank(spark, [("a", 1, "open", 5, "x")])
    seeds = spark.createDataFrame([("s", 7, 70, 7, "old")], "entity_id string, event_sequence long, balance long, n long, other string")
    assert rows(fold.fold_seeded(log, seeds, fields())) == [("a", 1, 5, 1, "x"), ("s", 7, 70, 7, "old")]


def test_counter_never_doubles(spark):
    log = spark.createDataFrame([("c", i, "inc") for i in range(1, 7)], "entity_id string, sequence long, type string")
    seeds = spark.createDataFrame([("c", 4, 4)], "entity_id string, event_sequence long, n long")
    assert fold.fold_seeded(log, seeds, {"n": Reducer("count")}).first().n == 6
