"""Language-model scoring by cross-entropy difference.

Two bigram models of one form, a target (texts rated good) and a background (all texts), over the words and pairs of words that the
texts hold, each a key of 63 bits. Both are counted over all documents, and the tables of counts grow with them. A text's score is its
loss a token under the target model less that under the background; lower is more like the target.

Texts are dealt out to blocks by a hash of their id. A block asks for the totals of its own distinct keys, range of keys by range; a
range adds up what all blocks hold and answers each. So a task holds a block's or a range's keys, however large the vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .search import _TABLE

#: Words that the unigram models share their floor among at least; more if the texts hold more.
VOCABULARY = 1 << 17
#: Counts that the unigram model adds for a pair's history, and that every word has besides its own.
MASS, FLOOR = 4.0, 0.5
#: Bytes of text a block, about; ranges of keys are as many as blocks, but so many at least.
BLOCK_BYTES, RANGES = 8 << 20, 512


def tokens(text: str | None, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(words, pairs) of a whole text as keys, words even and pairs odd; the first word's pair is with the text's start."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()
    get = known.get
    ids = [get(w) for w in words]
    if None in ids:
        if len(known) > 300_000:
            known.clear()
        for i, x in enumerate(ids):
            if x is None:
                ids[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
    h = np.array(ids, np.uint64) & ~np.uint64(1)
    before = np.concatenate([np.zeros(min(1, len(h)), np.uint64), h[:-1]])
    return h, (before * np.uint64(0x9E3779B97F4A7C15) + h) * np.uint64(0xC2B2AE3D27D4EB4F) | np.uint64(1)


def pack(*columns: np.ndarray) -> bytes:
    """Numbers of 64 bits byte by byte, compressed."""
    return pa.compress(
        b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8).T.tobytes() for c in columns), codec="zstd", asbytes=True
    )


def unpack(data: bytes, size: int, n: int) -> list[np.ndarray]:
    """The ``n`` columns of ``size`` numbers."""
    flat = np.frombuffer(pa.decompress(data, 8 * size * n, "zstd", asbytes=True), np.uint8).reshape(n, 8, size)
    return [np.ascontiguousarray(x.T).view(np.uint64).ravel() for x in flat]


class Block:
    """The rows of a block; equal texts are held once."""

    def __init__(self):
        self.rows: list[tuple[int | None, int]] = []
        self.at: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.pairs: list[np.ndarray] = []

    def add(self, doc: int | None, text: str | None, known: dict[bytes, int]) -> None:
        words, pairs = tokens(text, known)
        at = self.at.setdefault(xxhash.xxh3_128_digest(words.tobytes()), len(self.at))
        if at == len(self.words):
            self.words.append(words)
            self.pairs.append(pairs[1:])
        self.rows.append((doc, at))

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys in order, which of them each word of the texts in turn is, then each pair)."""
        return np.unique(np.concatenate([*self.words, *self.pairs, np.empty(0, np.uint64)]), return_inverse=True)

    def times(self, docs: set[int] | None = None) -> np.ndarray:
        """How often each text occurs, or does in some documents, for each word and then each pair."""
        n = np.bincount([at for doc, at in self.rows if docs is None or doc in docs], minlength=len(self.words))
        return np.concatenate([np.repeat(n, [len(x) for x in self.words]), np.repeat(n, [len(x) for x in self.pairs])])


class Model(NamedTuple):
    """Totals of the words and pairs of counted texts: ``answers`` has them by block (block, range, size, data: the totals of the
    block's distinct keys, in order), of which there are ``blocks``; ``words`` are distinct; ``sizes`` words are in target and
    background."""

    answers: DataFrame
    blocks: int
    words: int
    sizes: tuple[int, int]


def _block(blocks: int, text: Column | None = None) -> Column:
    """Null ids, which no label has, are dealt out by text."""
    own = F.xxhash64("doc_id")
    return F.pmod(own if text is None else F.when(F.col("doc_id").isNull(), F.xxhash64(text)).otherwise(own), F.lit(blocks)).alias("block")


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _by_block(first: DataFrame, docs: DataFrame, blocks: int) -> DataFrame:
    """``first`` (block and others) and the rows of ``docs``, a block after the other, the former before the latter (is_doc)."""
    rows = docs.select(_block(blocks, F.col("text")), F.lit(True).alias("is_doc"), "doc_id", "text")
    return first.withColumn("is_doc", F.lit(False)).unionByName(rows, allowMissingColumns=True).repartition("block").sortWithinPartitions("block", "is_doc")


def count(docs: DataFrame, labels: DataFrame) -> Model:
    """Counts both models over all rows. Rows rated good (quality, not toxic; of several ratings of a text the greatest of each) are
    the target. They grow with the texts, so they meet by a shuffle at every size."""
    rows = _rows(docs)
    with common.shuffles_go(docs.sparkSession):
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    bits = (max(RANGES, blocks) - 1).bit_length()
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max("quality").alias("q"), F.coalesce(F.max("toxic"), F.lit(0)).alias("t")
    ).where("q > 0 and t = 0").select(_block(blocks), "doc_id")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        now, held, good = None, Block(), set()

        def asked() -> Iterator[pa.RecordBatch]:
            keys, which = held.keys()
            if not len(keys):
                return
            n, target = (np.bincount(which, w, len(keys)).astype(np.uint64) for w in (held.times(), held.times(good)))
            cuts = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys)).tolist()
            out = [
                (now, r, b - a, pack(np.diff(keys[a:b], prepend=np.uint64(0)), n[a:b], target[a:b])) for r,
                (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                ["block", "range", "size", "data"]
            )

        for batch in batches:
            for block, is_doc, doc, text in zip(
                *(batch.column(c).to_pylist() for c in ("block", "is_doc", "doc_id")), batch.column("text"), strict=True
            ):
                if block != now:
                    yield from asked()
                    now, held, good = block, Block(), set()
                if is_doc:
                    held.add(doc, text.as_py(), known)
                else:
                    good.add(doc)
        yield from asked()

    def answer(group: pa.Table) -> pa.Table:
        block, r, size, data = (group.column(c).to_pylist() for c in ("block", "range", "size", "data"))
        got = [unpack(d, s, 3) for d, s in zip(data, size, strict=True)]
        keys, which = np.unique(np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got]), return_inverse=True)
        n, target = (np.bincount(which, np.concatenate([x[c] for x in got])).astype(np.uint64) for c in (1, 2))
        ends = np.cumsum(size).tolist()
        out = [pack(n[own], target[own]) for own in (which[e - s : e] for e, s in zip(ends, size, strict=True))]
        word = keys & np.uint64(1) == 0
        facts = [[int(x)] + [0] * (len(r) - 1) for x in (word.sum(), target[word].sum(), n[word].sum())]
        return pa.table(
            [
                pa.array(block, pa.int64()), pa.array(r, pa.int64()), pa.array(size, pa.int64()), pa.array(out, pa.binary()),
                *(pa.array(f, pa.int64()) for f in facts)
            ],
            ["block", "range", "size", "data", "words", "target", "background"]
        )

    form = "block long, range long, size long, data binary"
    asked = _by_block(good, rows, blocks).select("block", "is_doc", "doc_id", "text").mapInArrow(ask, form)
    answered = asked.groupBy("range").applyInArrow(answer, f"{form}, words long, target long, background long")
    with common.shuffles_go(docs.sparkSession):  # the texts are dealt out once more when they are scored
        answers = common.stored(answered, "totals")
    words, *sizes = (x or 0 for x in answers.agg(F.sum("words"), F.sum("target"), F.sum("background")).first())
    return Model(answers.select("block", "range", "size", "data"), blocks, words, tuple(sizes))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, difference for each row of the table that was counted; losses are null where a
    text has no word (null and empty texts too). Null doc_ids and repeated rows are kept as they are; an empty table gives no rows.
    Texts of any length are counted and scored whole; other columns, whatever their names, are ignored.

    A word's probability after another is (times seen after it + MASS * its unigram probability) / (the other's times + MASS); what a
    history lacks to 1 are the times that it ends a text. Unigram probabilities sum to 1 over the words and those not seen."""
    answers, blocks, vocabulary, sizes = model
    vocabulary = max(VOCABULARY, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        now, held, totals = None, Block(), []

        def scored() -> Iterator[pa.RecordBatch]:
            keys, which = held.keys()
            parts = [unpack(data, size, 2) for _, size, data in sorted(totals)]
            if sum(len(p[0]) for p in parts) != len(keys):
                raise ValueError("the texts are not those that were counted")
            length = np.array([len(x) for x in held.words], np.int64)
            full = np.flatnonzero(length)
            first = (np.cumsum(length) - length)[full]
            word, pair = which[: length.sum()], which[length.sum() :]
            losses = []
            for column, size in ((1, sizes[0]), (0, sizes[1])):
                n = np.concatenate([p[column] for p in parts]).astype(np.float64) if parts else np.empty(0)
                own = n[word]
                history, seen = np.concatenate([[0], own[:-1]])[: len(own)], np.zeros(len(own))
                inner = np.ones(len(own), bool)
                inner[first] = False  # the first word has no history
                history[first] = 0
                seen[inner] = n[pair]
                p = (own + FLOOR) / (size + FLOOR * vocabulary)
                loss = np.full(len(length), np.nan)
                if len(full):
                    loss[full] = np.add.reduceat(-np.log((seen + MASS * p) / (history + MASS)), first) / length[full]
                losses.append(loss)
            doc, at = zip(*held.rows, strict=True) if held.rows else ((), ())
            at = np.array(at, np.int64)
            for a in range(0, len(at), 10_000):
                b = at[a : a + 10_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc[a : a + 10_000], pa.int64()), pa.array(length[b], pa.int64()),
                        *(pa.array(x[b], pa.float64(), mask=length[b] == 0) for x in losses)
                    ],
                    ["doc_id", "n_tokens", "target_loss", "background_loss"]
                )

        for batch in batches:
            for block, is_doc, doc, r, size, data, text in zip(
                *(batch.column(c).to_pylist() for c in ("block", "is_doc", "doc_id", "range", "size", "data")), batch.column("text"),
                strict=True
            ):
                if block != now:
                    yield from scored()
                    now, held, totals = block, Block(), []
                if is_doc:
                    held.add(doc, text.as_py(), known)
                else:
                    totals.append((r, size, data))
        yield from scored()

    out = _by_block(answers, _rows(docs), blocks).mapInArrow(run, "doc_id long, n_tokens long, target_loss double, background_loss double")
    return out.withColumn("difference", F.col("target_loss") - F.col("background_loss"))
