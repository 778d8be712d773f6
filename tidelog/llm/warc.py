"""Content-addressed WARC archive: payload bytes once by strong digest, exact record headers apart, records by a join.

Layout under the archive's path: ``payloads`` (key: SHA-256 of the payload, payload, response: page_id of the record that
carries it) and ``headers`` (page_id, key or null, header: the record's bytes up to its payload). A response record is its
header, the payload and two line ends; a revisit record is its header and two line ends. ``export`` writes the records as WARC files,
a gzip member each, ``load`` reads such files, and ``parsed`` takes everything that it gives from the records' bytes.
"""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The alphabet of RFC 4648, and the digits that conv() writes in base 32.
BASE32, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def sha1_base32(data: Column) -> Column:
    """Upper-case base32 SHA-1: 160 bits are four groups of 40 bits, each eight digits."""
    hexed = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), DIGITS, BASE32)


def _record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("record "), F.coalesce(page_id.cast("string"), F.lit("null"))))
    return F.concat(
        F.lit("<urn:uuid:"),
        *(
            x for i,
            (at, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] * bool(i) + [F.substring(h, at, n)])
        ),
        F.lit(">")
    )


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; a null value leaves its line out."""
    return F.concat(*(F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit("")) for name, value in pairs), F.lit("\r\n"))


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes a record for each row of ``pages`` (page_id, url, html; other columns are ignored) to the archive at ``path``.

    Of records with equal payloads of at least ``least`` bytes, the one with the smallest page_id is a response and the others
    revisit it; smaller payloads are all responses. Null html is the empty payload; a null url leaves its header line out. A
    null page_id counts as the largest. Repeated rows of the smallest page_id are all responses. An empty table gives an empty
    archive.
    """
    url = F.regexp_replace(F.col("url").cast("string"), r"[\r\n]+", " ")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), url.alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("payload")
    )
    rows = rows.withColumn("key", F.unhex(F.sha2("payload", 256)))
    stored = rows.groupBy("key").agg(F.first("payload").alias("payload"), F.min("page_id").alias("response"))
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")

    firsts = pages.sparkSession.read.parquet(f"{path}/payloads").select("key", "response")
    narrow = rows.select(
        "page_id", "url", "key", F.octet_length("payload").cast("long").alias("n"), sha1_base32(F.col("payload")).alias("sha1")
    )
    all_ = narrow.join(firsts, "key").withColumn("revisit", (F.col("n") >= least) & ~F.col("page_id").eqNullSafe(F.col("response")))
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n")
    )
    size = F.octet_length(http) + F.when(F.col("revisit"), 0).otherwise(F.col("n"))
    head = _lines(
        ("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        ("WARC-Record-ID", _record_id(F.col("page_id"))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("url")),
        ("X-Page", F.col("page_id").cast("string")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Refers-To", F.when(F.col("revisit"), _record_id(F.col("response")))),
        ("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        ("X-Refers-To-Page", F.when(F.col("revisit"), F.col("response").cast("string"))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
        ("Content-Length", size.cast("string")),
    )
    header = F.encode(F.concat(F.lit("WARC/1.1\r\n"), head, http), "utf-8")
    all_.select("page_id", "key", "revisit", header.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read(spark: SparkSession, path: str) -> DataFrame:
    """page_id, revisit, header, payload (the full payload, for revisits too), record (the exact bytes as written to a file).

    Each payload is checked against its key; one that differs stops the read."""
    payloads = spark.read.parquet(f"{path}/payloads")
    sound = F.when(
        F.unhex(F.sha2("payload", 256)) == F.col("key"), F.col("payload")
    ).otherwise(F.raise_error(F.lit("a stored payload differs from its digest")).cast("binary"))
    joined = spark.read.parquet(f"{path}/headers").join(payloads.select("key", sound.alias("payload")), "key")
    end = F.lit(b"\r\n\r\n")
    record = F.when(F.col("revisit"), F.concat("header", end)).otherwise(F.concat("header", "payload", end))
    return joined.select("page_id", "revisit", "header", "payload", record.alias("record"))


#: A gzip member that holds nothing: what stands between the records' members.
_NOTHING = gzip.compress(b"", mtime=0).decode("latin-1")


def export(records: DataFrame, path: str) -> None:
    """Writes the records (column record) as WARC files under ``path``, one a partition, each record a gzip member of its own, so that a
    reader may begin at any of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                members = [gzip.compress(r, mtime=0) for r in batch.column(0).slice(at, 64).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["member"])

    spark = records.sparkSession
    members = records.select("record").mapInArrow(run, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.option("encoding", "ISO-8859-1").option("lineSep", _NOTHING).text(path)
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = there.getFileSystem(spark._jsc.hadoopConfiguration())
    for file in fs.listStatus(there):
        name = file.getPath().getName()
        if name.endswith(".txt"):
            fs.rename(file.getPath(), spark._jvm.org.apache.hadoop.fs.Path(there, name.removesuffix(".txt") + ".warc.gz"))


def load(spark: SparkSession, path: str) -> DataFrame:
    """record: the bytes of each record in the gzipped WARC files under ``path``. A file is one task's, its records are taken from it one by
    one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                data, out = memoryview(content.as_buffer()), []
                while len(data):
                    member = zlib.decompressobj(31)
                    record = member.decompress(data)
                    data = data[len(data) - len(member.unused_data) :] if member.eof else data[:0]
                    if not member.eof:
                        raise ValueError("a WARC file ends within a record")
                    if record:
                        out.append(record)
                    if len(out) == 64:
                        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                        out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path)
    return files.select("content").mapInArrow(run, "record binary")


def parsed(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, all from the bytes of the records (column record).

    A record is taken apart by its own lengths. A response's payload is held against the digest in its header; a revisit's digest and
    length against those of the response that it names. What differs, or is cut off, stops the query."""
    stop = lambda why, kind: F.raise_error(F.lit(why)).cast(kind)
    line = lambda name, text: F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    # bytes as characters of one byte, so that places are those of bytes
    text = records.select(F.decode("record", "ISO-8859-1").alias("r")).withColumn("cut", F.instr("r", "\r\n\r\n"))
    split = text.select("r", "cut", F.concat(F.substring("r", F.lit(1), F.col("cut") + 1)).alias("head"))
    block = split.select(
        "head", F.expr("substring(r, cut + 4)").alias("rest"), line("Content-Length", F.col("head")).cast("int").alias("size")
    )
    block = block.select(
        "head", "size", F.expr("substring(rest, 1, size)").alias("block"), F.expr("substring(rest, size + 1)").alias("end")
    )
    block = block.withColumn(
        "block", F.when(F.col("end") == "\r\n\r\n", F.col("block")).otherwise(stop("a record is not as long as it says", "string"))
    )
    parts = block.select(
        "head", F.expr("substring(block, 1, instr(block, '\r\n\r\n') + 1)").alias("http"),
        F.expr("substring(block, instr(block, '\r\n\r\n') + 4)").alias("body")
    )
    facts = parts.select(
        line("X-Page", F.col("head")).alias("p"), line("X-Refers-To-Page", F.col("head")).alias("x"), line("Content-Length", F.col("http")).alias("n"),
        line("WARC-Type", F.col("head")).alias("record_type"), F.substring(
            line("WARC-Payload-Digest", F.col("head")), 6, 32
        ).alias("digest"), F.encode("body", "ISO-8859-1").alias("payload"),
    )
    whole = (F.col("digest") == sha1_base32(F.col("payload"))) & (number("n") == F.octet_length("payload"))
    sound = F.when(
        (F.col("record_type") == "revisit") | whole, F.col("digest")
    ).otherwise(stop("a payload differs from its record's digest", "string"))
    facts = facts.select(
        number("p").alias("page_id"), number("n").alias("payload_bytes"), sound.alias("payload_digest"), "record_type",
        number("x").alias("refers_to")
    )
    facts = common.stored(facts, "records")
    named = facts.where("record_type = 'response'").select(
        F.col("page_id").alias("of"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("b")
    ).distinct()
    met = facts.where("record_type = 'revisit'").join(
        named, (F.col("refers_to") == F.col("of")) & (F.col("payload_digest") == F.col("d")) & (F.col("payload_bytes") == F.col("b")),
        "left"
    )
    met = met.withColumn(
        "payload_digest",
        F.when(
            F.col("of").isNotNull(), F.col("payload_digest")
        ).otherwise(stop("a revisit's payload is not that of the response that it names", "string"))
    )
    return facts.where("record_type = 'response'").unionByName(met.select(*facts.columns))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    path = common.new_path(pages.sparkSession, "warc")
    write(pages, path, least)
    return parsed(read(pages.sparkSession, path))
