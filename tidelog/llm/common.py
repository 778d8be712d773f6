"""Helpers shared by the text operators: tables, shared working folder, Arrow batches, connected components."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Session setting: so many tasks read a table, dealt out by a shuffle. Unset, as on a cluster: those of its files' splits.
SCAN_TASKS = "tidelog.scan.tasks"


def dealt(scan: DataFrame) -> DataFrame:
    """The scan, over SCAN_TASKS tasks where the session asks for that (a table that is one file of one row group, on one machine)."""
    tasks = scan.sparkSession.conf.get(SCAN_TASKS, None)
    return scan.repartition(int(tasks)) if tasks else scan


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. A local master (tests) gets one of its own where the session names none; any other
    must name it, as files of one machine would be lost to the others without an error."""
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not there:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        there = f"file://{tempfile.mkdtemp(prefix='tidelog-')}"
        spark.sparkContext.setCheckpointDir(there)
    return there.rstrip("/")


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/tidelog/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Cuts the lineage: writes ``df`` as a table in the shared folder and reads it back, so a lost executor costs no rerun. ``rows``: about
    how many there are, where that is known."""
    path = new_path(df.sparkSession, what)
    (df if rows is None else df.coalesce(tasks(rows))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def passed(df: DataFrame, what: str) -> tuple[DataFrame, Callable[[], None]]:
    """As ``stored`` for a large table that is needed for a while: compressed well, and what removes it."""
    path = new_path(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), lambda: remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


#: Spark's setting: the shuffle files of a query go when it ends, and not when the driver next happens to collect garbage.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files. (A query of another thread that ends meanwhile leaves none either; should it be
    collected again, Spark makes them again.)"""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_GO)
        else:
            spark.conf.set(SHUFFLES_GO, before)


def quoted(name: str) -> str:
    """A column's name as ``F.col`` takes it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def by_batch(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with per-task state: ``make()`` runs once in each task and returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            if batch.num_rows and (out := each(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def filtered(docs: DataFrame, make: Callable[[], Callable[[str | None], bool]]) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) whose text passes the test that ``make()`` returns in each task."""
    at, numbered = docs.columns.index("text"), docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passes = make()
        for whole in batches:
            for first in range(0, whole.num_rows, 1024):
                batch = whole.slice(first, 1024)
                yield batch.filter(pa.array([passes(t.as_py()) for t in batch.column(at)], pa.bool_()))

    return numbered.mapInArrow(run, numbered.schema).toDF(*docs.columns)


#: Rows of a table for each task that writes it, where they are known: a loop over small tables then writes few files.
TASK_ROWS = 20_000


def tasks(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """Smallest node reachable from each node of undirected ``edges`` (a, b: long): columns node, component.

    Large-star and small-star steps in turn. The minima are stored before they are joined back, so a node of very high degree
    costs one row a task in the aggregate, and in the join its edges are a skewed partition that Spark can split. What is stored is
    written by tasks in proportion to the edges, of which no step makes more.
    """
    spark = edges.sparkSession
    now = edges.where("a is not null and b is not null and a <> b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    ).distinct()
    now = stored(now, "edges")
    rows = now.count()
    if not rows:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    few = tasks(2 * rows)
    old: list[str] = []
    mark = None

    def kept(df: DataFrame) -> DataFrame:
        path = new_path(spark, "cc")
        df.coalesce(few).write.parquet(path)
        old.append(path)
        return spark.read.schema(df.schema).parquet(path)

    while True:
        done = list(old)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")))
        large = kept(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        # (of a node's smaller neighbours there are few now, so these minima meet their edges as they are)
        small = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.col("v").alias("x"), "u", "m")
        small = small.select(
            F.col("x").alias("u"), F.col("m").alias("v")
        ).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = kept(small)
        for path in [*done, *old[len(done) : -1]]:
            remove(spark, path)
        del old[:-1]
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            return now.select(
                F.col("u").alias("node"), F.col("v").alias("component")
            ).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        mark = tuple(row)
