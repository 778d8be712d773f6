"""Line dedup by content-defined chunks, in DataFrame functions only.

A rolling hash over the hashes of each two neighbouring lines tells whether the pair recurs in the table. A chunk is a run of lines
that such copied pairs (or copied long lines) cover: it begins and ends where the rolling hash recurs no more. That depends on the
lines there alone, so a passage has the same boundaries wherever it stands, whatever is shifted before it. Pairs are compared byte by
byte before they count as copies; a chunk with the words of a passage goes, and its lines stay at the first place of each pair.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words (parts of a line between spaces) that a chunk has at least to be removed; a line of so many is compared on its own too.
PASSAGE = 50
#: Share of a text's words from which on it is a copy of documents rather than a document with copied passages.
WHOLE = 0.8


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f(value)`` with the value computed once a row, however often ``f`` uses it."""
    return F.transform(F.array(value), f)[0]


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _words(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.length(line) - F.length(F.translate(line, " ", "")) + 1)


def _total(lines: Column) -> Column:
    return F.aggregate(lines, F.lit(0), lambda n, x: n + _words(x))


def units(text: Column) -> Column:
    """Array of (at, n, hash): each two neighbouring lines (n 2) and each line with the words of a passage (n 1) from line ``at`` on.
    The hash of two is rolled: that of the first, turned by a bit, with that of the second (a cyclic polynomial)."""
    turned = lambda h: F.shiftleft(h, 1).bitwiseOR(F.shiftrightunsigned(h, 63))
    unit = lambda at, n, h: F.struct(at.cast("int").alias("at"), F.lit(n).alias("n"), h.alias("hash"))

    def found(lines: Column, hashes: Column) -> Column:
        two = F.transform(
            F.slice(hashes, 1, F.size(hashes) - 1), lambda h, i: unit(i, 2, turned(h).bitwiseXOR(F.element_at(hashes, i + 2)))
        )
        long = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: _words(F.element_at(lines, i + 1)) >= PASSAGE)
        return F.concat(two, F.transform(long, lambda i: unit(i, 1, F.element_at(hashes, i + 1))))

    return _let(_lines(text), lambda lines: _let(F.transform(lines, lambda x: F.xxhash64(x)), lambda hashes: found(lines, hashes)))


def without(text: Column, gone: Column, whole: float | None) -> Column:
    """Struct (text, n): the text without the chunks that ``gone`` (array of (at, n)) covers, and their number. Nothing goes if the
    chunks have the share ``whole`` of the words."""

    def runs(lines: Column) -> Column:
        covered = F.array_sort(F.array_distinct(F.flatten(F.transform(gone, lambda u: F.sequence(u["at"], u["at"] + u["n"] - 1)))))

        def joined(c: Column) -> Column:
            first = F.filter(c, lambda x, j: (j == 0) | (x != F.get(c, j - 1) + 1))
            last = F.filter(c, lambda x, j: (j == F.size(c) - 1) | (F.get(c, j + 1) != x + 1))
            return F.zip_with(
                first, last, lambda a, b: F.struct(a.alias("a"), b.alias("b"), _total(F.slice(lines, a + 1, b - a + 1)).alias("words"))
            )

        return F.filter(_let(covered, joined), lambda r: r["words"] >= PASSAGE)

    def left(lines: Column, chunks: Column) -> Column:
        begin = F.concat(F.array(F.lit(0)), F.transform(chunks, lambda r: r["b"] + 1))
        end = F.concat(F.transform(chunks, lambda r: r["a"] - 1), F.array(F.size(lines) - 1))
        kept = F.filter(F.zip_with(begin, end, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda r: r["b"] >= r["a"])
        rest = F.array_join(F.transform(kept, lambda r: F.array_join(F.slice(lines, r["a"] + 1, r["b"] - r["a"] + 1), "\n")), "\n")
        cut = F.struct(rest.alias("text"), F.size(chunks).cast("long").alias("n"))
        if whole is None:
            return cut
        words = F.aggregate(chunks, F.lit(0), lambda n, r: n + r["words"])
        return F.when(words >= whole * _total(lines), F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))).otherwise(cut)

    return _let(_lines(text), lambda lines: _let(runs(lines), lambda chunks: left(lines, chunks)))


def dedup(docs: DataFrame, whole: float | None = None, count: str = "n_removed") -> DataFrame:
    """``docs`` with its own columns, ``text`` without the chunks that stand earlier in the table, and n_removed (their number; ``count`` is
    another name for it).

    Two neighbouring lines (or one of PASSAGE words) are a copy if the same, byte by byte, stand at an earlier place: one with a
    smaller (doc_id, hash of text, line); a null doc_id comes last. Lines that copies cover without a gap are a chunk; those of
    PASSAGE words or more go. No line goes without an equal one that stays. What is left of a text is joined by line feeds; a text that
    loses all is empty. With ``whole``, texts of which chunks have that share of the words or more are left as they are.

    Null text stays null, empty text and those with fewer words than a passage stay as they are. Rows with equal doc_id and text are
    the same place and get the same result each. A column n_removed that the table has is replaced, other columns may have any names.
    Texts and lines of any length are compared whole. An empty table gives none.
    """
    names = [c for c in docs.columns if c.lower() != count.lower()]
    text = F.col("text").cast("string")
    own = docs.select(
        F.struct(*map(common.quoted, names)).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("key"),
        text.alias("body")
    )
    # places and hashes only: no texts are dealt out to find what recurs
    found, units_done = common.passed(
        own.select("doc", "key", F.explode(units(F.col("body"))).alias("u")).select("doc", "key", "u.*"), "units"
    )
    often, often_done = common.passed(
        found.groupBy("n", "hash").agg(F.count("*").alias("times")).where("times > 1").select("n", "hash"), "often"
    )
    asked = found.join(often.hint("merge"), ["n", "hash"], "left_semi").groupBy(
        F.col("doc").alias("d"), F.col("key").alias("k")
    ).agg(F.collect_set(F.struct("at", "n")).alias("asked"))
    there = F.col("doc").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    rows, _ = common.passed(own.join(asked, there, "left").drop("d", "k", "body"), "rows")
    units_done()
    often_done()

    text = F.col("row").getField("text").cast("string")
    some = rows.where("asked is not null")
    bodies = some.select(
        "doc", "key",
        F.explode(_let(
            _lines(text),
            lambda x: F.transform(
                "asked",
                lambda u: F.struct(
                    u["at"].alias("at"), u["n"].alias("n"), F.array_join(F.slice(x, u["at"] + 1, u["n"]), "\n").alias("body")
                )
            )
        )).alias("u")
    )
    bodies = bodies.select(
        "u.n", F.unhex(F.sha2("u.body", 256)).alias("digest"),
        F.struct(F.col("doc").isNull().alias("none"), "doc", "key", "u.at").alias("place"), "u.body"
    )
    # equal bytes: of all that have a digest the least and the greatest are the same; a hot chunk is one row a task
    first = bodies.groupBy("n", "digest").agg(
        F.min("place").alias("first"), F.max("place").alias("last"), (F.min("body") == F.max("body")).alias("same")
    )
    # (stored before it is joined back, by a shuffle at every size: a hot chunk is then a skewed side, which Spark can split)
    first = common.stored(
        first.where("first <> last").select(
            "n", "digest", "first",
            F.when(F.col("same"), True).otherwise(F.raise_error(F.lit("texts of one SHA-256 differ")).cast("boolean")).alias("same")
        ),
        "first"
    )
    copies = bodies.drop("body").join(first.hint("merge"), ["n", "digest"]).where("same and place <> first")
    gone = copies.groupBy(
        F.col("place.doc").alias("d"), F.col("place.key").alias("k")
    ).agg(F.collect_set(F.struct("place.at", "n")).alias("gone"))

    field = lambda c: F.col("row").getField(c).alias(c)
    less = some.join(gone, there, "left").withColumn("new", F.when(F.col("gone").isNotNull(), without(text, F.col("gone"), whole)))
    less = less.select(
        *(F.coalesce("new.text", text).alias(c) if c == "text" else field(c) for c in names),
        F.coalesce("new.n", F.lit(0).cast("long")).alias(count)
    )
    return rows.where("asked is null").select(
        *(text.alias(c) if c == "text" else field(c) for c in names), F.lit(0).cast("long").alias(count)
    ).unionByName(less)
