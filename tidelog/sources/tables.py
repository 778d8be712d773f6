"""The driver's tables as event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C

#: Events of a commit, and the snapshot interval, of the logs made here.
COMMIT, SNAPSHOT_EVERY = 3, 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _committed(rows: DataFrame) -> DataFrame:
    commit = F.floor((F.col("sequence") - 1) / COMMIT).cast("long")
    return rows.withColumn("commit_no", commit).withColumns({
        "event_id": C.event_id(), "commit_id": F.concat("entity_id", F.lit(":c"), commit.cast("string"))
    }).withColumn("command_id", F.col("commit_id"))


def user_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events in order of time. The id comes first, so one shuffle serves the numbering and what groups by entity."""
    e = table(spark, sf_dir, "events").withColumn("entity_id", F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    seq = F.row_number().over(Window.partitionBy("entity_id").orderBy("ts", "event_id")).cast("long")
    rows = e.select(
        "entity_id", seq.alias("sequence"), F.col("event_type").alias("type"), (1 + F.col("event_id") % 2).cast("long").alias("version"),
        F.lit("user").alias("entity_type"), F.round(F.col("value") * 100).cast("long").alias("cents"),
        F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_id").alias("src_id"), "ts"
    )
    return _committed(rows).withColumn("payload", C.to_json(F.struct("cents", "k")))


def conversation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("entity_id"), (F.col("turn") + 1).cast("long").alias("sequence"),
        F.col("role").alias("type"), F.lit(1).cast("long").alias("version"), F.lit("conversation").alias("entity_type"),
        F.length("text").cast("long").alias("cents"), F.lit(None).cast("long").alias("k")
    )


def order_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order: created, then its lines in the order of all their columns."""
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")).alias("entity_id"), F.lit(1).cast("long").alias("sequence"),
        F.lit("created").alias("type"), F.lit(1).cast("long").alias("version"), F.lit("order").alias("entity_type"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.lit(None).cast("long").alias("k")
    )
    lines = table(spark, sf_dir, "lineitem").withColumn("entity_id", F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")))
    every = [
        "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate"
    ]
    seq = (1 + F.row_number().over(Window.partitionBy("entity_id").orderBy(*every))).cast("long")
    added = lines.select(
        "entity_id", seq.alias("sequence"), F.lit("line").alias("type"), F.lit(1).cast("long").alias("version"),
        F.lit("order").alias("entity_type"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.col("l_quantity").cast("long").alias("k")
    )
    return o.unionByName(added)


def whole_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["entity_id", "sequence", "type", "version", "entity_type", "cents"]
    return user_log(spark, sf_dir).select(*cols).unionByName(conversation_log(spark, sf_dir).select(*cols)).unionByName(order_log(spark, sf_dir).select(*cols))


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends that claim (order, line number); arrival is a total order within a key."""
    lines = table(spark, sf_dir, "lineitem").withColumn("entity_id", F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")))
    every = [
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
        "l_shipdate"
    ]
    arrival = F.row_number().over(Window.partitionBy("entity_id").orderBy(*every)).cast("long")
    return lines.select(
        "entity_id", F.col("l_linenumber").cast("long").alias("sequence"), arrival.alias("arrival"),
        F.concat("entity_id", F.lit("/"), arrival.cast("string")).alias("commit_id")
    )


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change records of the user log: every 7th source event is a MODIFY, every 11th has no image, every 13th blank metadata, every
    17th broken metadata; others have a command id unless divisible by 3, and a traceparent."""
    log = user_log(spark, sf_dir)
    s = F.col("src_id")
    trace = F.concat(F.lit("t-"), s.cast("string"))
    good = F.when(
        s % 3 == 0, F.concat(F.lit('{"trace":{"traceparent":"'), trace, F.lit('"},"region":"r"}'))
    ).otherwise(F.concat(
        F.lit('{"commandId":"'), F.col("command_id"), F.lit('","trace":{"traceparent":"'), trace, F.lit('"},"region":"r"}')
    ))
    meta = F.when(s % 13 == 0, " ").when(s % 17 == 0, '{"region":"r"').otherwise(good)
    image = F.struct(
        F.col("entity_id").alias("pk"), F.col("sequence").alias("sk"), F.col("type"), F.col("version"),
        F.col("entity_type").alias("entityType"), F.col("payload"), meta.alias("metadata"), F.lit(None).cast("long").alias("ttl"),
        F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("eventSeq")
    )
    return log.select(
        F.concat(F.lit("rec-"), s.cast("string")).alias("event_id"), F.when(s % 7 == 0, "MODIFY").otherwise("INSERT").alias("event_name"),
        F.when(s % 5 == 0, "").otherwise(s.cast("string")).alias("sequence_number"), F.when(s % 11 != 0, image).alias("new_image"),
        F.col("src_id")
    )
