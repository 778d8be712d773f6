"""Exact top-k search by BM25 with block-max pruning.

The rows are read and tokenised once, into an inverted index that is stored by shard: a shard holds at most SHARD_ROWS rows or POSTINGS
postings. In a shard the rows are in an order that brings alike rows together, cut into blocks, and each term has its greatest impact
in each block. For a query, the sum of its terms' block maxima bounds the score of every row of a block. The blocks with the greatest
bounds are scored first; the others are skipped if their bound doesn't reach the k-th best score so far, which a task carries on from
shard to shard. Queries are taken together: terms that many rows and queries share are columns of a matrix, so bounds and scores of a
block are a product for all queries that still need it; other terms are scattered from their postings. Scores use the statistics of all
rows, so the shards' lists merge exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

K1, B = 1.2, 0.75
#: Rows of a block, blocks that are scored first, rows and postings that a shard holds at most (a single row may have more), parts that it
#: is stored in, and (posting, query) pairs that are held at once.
ROWS, FIRST, SHARD_ROWS, POSTINGS, PARTS, PAIRS = 64, 2, 8192, 2_000_000, 8, 4_000_000
#: A term is a column if more than one of so many (row, query) pairs share it; columns at most (the rarest go back to postings).
SHARED, COLUMNS = 1000, 1024
#: Query terms (over all queries) that are sent to the tasks at once; larger query sets are taken in blocks.
BLOCK_TERMS = 3_000_000
#: Scores are rounded to so many places; rows of equal score are in order of doc_id.
PLACES = 6
#: ASCII that is no letter or digit separates words.
_TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: str | None, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted term hashes, counts, length) of a whole text."""
    words = (text or "").lower().encode("utf-8", "replace").translate(_TABLE).split()
    get, digest = known.get, xxhash.xxh3_64_intdigest
    ids = [get(w) for w in words]
    if None in ids:
        if len(known) > 300_000:
            known.clear()
        for i, x in enumerate(ids):
            if x is None:
                ids[i] = known[words[i]] = digest(words[i])
    found, n = np.unique(np.array(ids, np.uint64), return_counts=True)
    return found, n, len(words)


def _ranges(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = end - first
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Queries:
    """A block of queries: vocabulary (sorted hashes), ids, and the queries of each slot (one list after another)."""

    def __init__(self, rows: list[tuple[int, np.ndarray]]):
        self.vocabulary = np.unique(np.concatenate([t for _, t in rows])) if rows else np.empty(0, np.uint64)
        self.ids = np.array([i for i, _ in rows], np.int64)
        slot = np.searchsorted(self.vocabulary, np.concatenate([t for _, t in rows])) if rows else np.empty(0, np.int64)
        by = np.argsort(slot, kind="stable")
        self.slot = slot[by]
        self.row = np.repeat(np.arange(len(rows)), [len(t) for _, t in rows])[by]
        self.first = np.searchsorted(self.slot, np.arange(len(self.vocabulary) + 1))
        self.idf = np.zeros(len(self.vocabulary))


class Shard:
    """The postings of a block's query terms in a shard: of each row the terms (places in the queries' vocabulary) and counts."""

    def __init__(self, ids: list[int], lengths: list[int], slots: list[np.ndarray], counts: list[np.ndarray], mean: float):
        row = np.repeat(np.arange(len(ids)), [len(s) for s in slots])
        self._set(np.array(ids, np.int64), np.array(lengths, np.float64), np.concatenate(slots), np.concatenate(counts), row, mean)

    @classmethod
    def read(cls, stored: list[dict], q: Queries, mean: float) -> Shard:
        """From parts, rows of the index."""
        take = lambda c, t: np.concatenate([np.frombuffer(part[c], t) for part in stored])
        ids, found = take("ids", np.int64), take("terms", np.uint64)
        at = np.searchsorted(q.vocabulary, found)
        at[at == len(q.vocabulary)] = 0
        same = q.vocabulary[at] == found
        out = cls.__new__(cls)
        out._set(
            ids, take("lengths", np.int64).astype(np.float64), at[same], take("counts", np.uint32)[same].astype(np.float64),
            np.repeat(np.arange(len(ids)), take("sizes", np.int64))[same], mean
        )
        return out

    def _set(self, ids: np.ndarray, lengths: np.ndarray, slot: np.ndarray, tf: np.ndarray, row: np.ndarray, mean: float) -> None:
        # the row's most frequent query term, of equal ones the first
        lead = np.full(len(ids), -1)
        first = np.lexsort((slot, -tf, row))
        first = first[np.flatnonzero(np.diff(row[first], prepend=-1))]
        lead[row[first]] = slot[first]
        order = np.lexsort((lengths, lead))
        self.ids, lengths = ids[order], lengths[order]
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        by = np.argsort(back[row], kind="stable")
        self.slot, self.row, tf = slot[by], back[row][by], tf[by]
        self.impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[self.row] / mean))

    def top(self, q: Queries, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query ids, row ids, scores) of the rows of each query that share a term with it and can be among its k best. ``floor``: the
        k-th best score of each query in shards before; raised to what this shard adds."""
        n, size = len(q.ids), len(self.ids)
        floor = np.zeros(n) if floor is None else floor
        blocks = -(-size // ROWS)
        weight = self.impact * q.idf[self.slot]
        # columns: terms that so many rows and queries share that a product is cheaper than postings
        shared = np.bincount(self.slot, minlength=len(q.vocabulary)) * np.diff(q.first)
        column = np.full(len(q.vocabulary), -1)
        often = np.flatnonzero(shared > n * size / SHARED)
        often = often[np.argsort(-shared[often], kind="stable")][:COLUMNS]
        column[often] = np.arange(len(often))
        rows, asked = np.zeros((blocks * ROWS, len(often))), np.zeros((n, len(often)))
        dense = column[self.slot] >= 0
        rows[self.row[dense], column[self.slot[dense]]] = weight[dense]
        asked[q.row[column[q.slot] >= 0], column[q.slot[column[q.slot] >= 0]]] = 1
        slot, row, weight = self.slot[~dense], self.row[~dense], weight[~dense]

        def scattered(slot: np.ndarray, to: np.ndarray, weight: np.ndarray, width: int) -> np.ndarray:
            """(query, place) sums of weights at places ``to`` over the queries of each slot."""
            first, end = q.first[slot], q.first[slot + 1]
            size = end - first
            upto, out, a = np.cumsum(size), np.zeros(n * width), 0
            while a < len(size):
                b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, "right")))
                at = q.row[_ranges(first[a:b], end[a:b])] * width + np.repeat(to[a:b], size[a:b])
                out += np.bincount(at, weights=np.repeat(weight[a:b], size[a:b]), minlength=n * width)
                a = b
            return out.reshape(n, width)

        by = np.lexsort((row, slot))
        key = slot[by] * blocks + row[by] // ROWS
        start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        most = np.maximum.reduceat(weight[by], start) if len(start) else np.empty(0)
        bound = scattered(slot[by][start], row[by][start] // ROWS, most, blocks)
        bound += asked @ rows.reshape(blocks, ROWS, len(often)).max(axis=1).T

        rank = np.empty(blocks * ROWS, np.int64)
        by_id = np.lexsort((np.arange(size), self.ids))
        rank[by_id] = np.arange(size, 0, -1)  # of equal scores the smaller doc_id is the greater key
        bits = np.int64(int(size + 1).bit_length())
        best = np.zeros((n, k), np.int64)
        lead = np.zeros((n, blocks), bool)
        few = min(FIRST, blocks)
        np.put_along_axis(lead, np.argpartition(bound, blocks - few, axis=1)[:, blocks - few :], True, axis=1)
        edge = np.searchsorted(row, np.arange(blocks + 1) * ROWS)
        for first in (True, False):
            for b in range(blocks):
                need = (lead[:, b] if first else ~lead[:, b]) & (bound[:, b] >= floor - 2 * 10.0**-PLACES) & (bound[:, b] > 0)
                some = np.flatnonzero(need)
                if not len(some):
                    continue
                a, e = edge[b], edge[b + 1]
                total = scattered(slot[a:e], row[a:e] - b * ROWS, weight[a:e], ROWS)[some]
                total += asked[some] @ rows[b * ROWS : (b + 1) * ROWS].T
                keys = (np.rint(total * 10**PLACES).astype(np.int64) << bits) + rank[b * ROWS : (b + 1) * ROWS]
                keys[total <= 0] = 0
                both = np.concatenate([best[some], keys], axis=1)
                best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, both.shape[1] - k :]
                floor[some] = np.maximum(floor[some], (best[some].min(axis=1) >> bits) / 10**PLACES)
        query, at = np.nonzero(best)
        found = best[query, at]
        return q.ids[query], self.ids[by_id][size - (found & ((np.int64(1) << bits) - 1))], (found >> bits) / 10**PLACES


def build(docs: DataFrame) -> DataFrame:
    """The index of ``docs`` (doc_id long, text string): a row for each part of a shard, with rows and words (numbers), and as bytes the rows' ids, lengths and
    numbers of terms (64-bit), and their terms (64-bit, in order within a row) and counts (32-bit), a row after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        ids, lengths, sizes, found, counts = [], [], [], [], []

        def flush() -> pa.RecordBatch:
            columns = [
                np.array(ids, np.int64), np.array(lengths, np.int64), np.array(sizes, np.int64), np.concatenate(found),
                np.concatenate(counts)
            ]
            row = [
                pa.array([len(ids)], pa.int64()), pa.array([int(columns[1].sum())], pa.int64()),
                *(pa.array([c.tobytes()], pa.binary()) for c in columns)
            ]
            for x in (ids, lengths, sizes, found, counts):
                x.clear()
            return pa.RecordBatch.from_arrays(row, ["rows", "words", "ids", "lengths", "sizes", "terms", "counts"])

        held = 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                t, n, length = terms(text.as_py(), known)
                if ids and (len(ids) >= -(-SHARD_ROWS // PARTS) or held + len(t) > POSTINGS // PARTS):
                    yield flush()
                    held = 0
                for x, y in zip((ids, lengths, sizes, found, counts), (doc, length, len(t), t, n.astype(np.uint32)), strict=True):
                    x.append(y)
                held += len(t)
        if ids:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(
        run, "rows long, words long, ids binary, lengths binary, sizes binary, terms binary, counts binary"
    )


def _statistics(index: DataFrame, queries: Queries) -> float:
    """Sets the queries' idf over all rows; the rows' mean length. A task gives one row for each term that it has."""
    shared = index.sparkSession.sparkContext.broadcast(queries.vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value
        df = np.zeros(len(vocabulary) + 1, np.int64)
        for batch in batches:
            for stored in batch.column("terms"):
                found = np.frombuffer(stored.as_buffer(), np.uint64)
                at = np.searchsorted(vocabulary, found)
                at[at == len(vocabulary)] = 0
                df += np.bincount(at[vocabulary[at] == found], minlength=len(df))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at])], ["slot", "n"])

    got = index.select("terms").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    shared.unpersist()
    rows, words = (x or 0 for x in index.agg(F.sum("rows"), F.sum("words")).first())
    df = np.zeros(len(queries.vocabulary))
    df[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    queries.idf = np.log(1 + (rows - df + 0.5) / (df + 0.5))
    return words / max(rows, 1)


def _blocks(queries: DataFrame) -> Iterator[Queries]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([terms(t.as_py(), known)[0].tobytes() for t in batch.column("text")], pa.binary())],
                ["doc_id", "terms"]
            )

    held, size = [], 0
    for row in queries.mapInArrow(run, "doc_id long, terms binary").toLocalIterator():
        found = np.frombuffer(bytes(row.terms), np.uint64)
        if held and size + len(found) > BLOCK_TERMS:
            yield Queries(held)
            held, size = [], 0
        held.append((row.doc_id, found))
        size += len(found)
    if held:
        yield Queries(held)


def search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank (from 1), doc_id, score: the k best rows of ``docs`` for each row of ``queries`` (both doc_id, text), by the sum
    over the query's distinct words of idf * BM25 weight. Rows that share no word are no results.

    Rows with a null doc_id are left out; null text has no words, as a row and as a query. Repeated rows of docs are results each;
    queries with equal doc_id are one (the least text). Ties are in order of doc_id. Texts of any length are read whole; other columns,
    whatever their names, are ignored. Empty tables give no rows.
    """
    pick = lambda t: t.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    ).where("doc_id is not null")
    docs, queries = pick(docs), pick(queries).groupBy("doc_id").agg(F.min("text").alias("text"))
    index, _ = common.passed(build(docs), "index")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    out = None
    for block in _blocks(queries):
        if not len(block.vocabulary):
            continue
        mean = _statistics(index, block)
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], shared=shared, mean=max(mean, 1e-9)) -> Iterator[pa.RecordBatch]:
            q = shared.value
            floor, parts, rows, postings = np.zeros(len(q.ids)), [], 0, 0
            place = np.argsort(q.ids)
            best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]

            def searched() -> None:
                """The k best rows of each query so far, of equal scores the smaller ids; their k-th score is what a row must reach."""
                found = Shard.read(parts, q, mean).top(q, k, floor)
                parts.clear()
                query, doc, score = (np.concatenate(x) for x in zip(best, found, strict=True))
                by = np.lexsort((doc, -score, query))
                first = np.flatnonzero(np.diff(query[by], prepend=query[by][:1] - 1))
                rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
                best[:] = [x[by[rank < k]] for x in (query, doc, score)]
                last = by[rank == k - 1]
                floor[place[np.searchsorted(q.ids, query[last], sorter=place)]] = score[last]

            for batch in batches:
                for at in range(batch.num_rows):
                    part = batch.slice(at, 1).to_pylist()[0]
                    size = len(part["terms"]) // 8
                    if parts and (rows + part["rows"] > SHARD_ROWS or postings + size > POSTINGS):
                        searched()
                        rows = postings = 0
                    parts.append(part)
                    rows, postings = rows + part["rows"], postings + size
            if parts:
                searched()
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best], ["query_id", "doc_id", "score"])

        # each block's results are kept before the next block is sent
        found = index.select(
            "rows", "ids", "lengths", "sizes", "terms", "counts"
        ).mapInArrow(run, "query_id long, doc_id long, score double")
        found = common.stored(
            found.withColumn(
                "rank", F.row_number().over(best).cast("long")
            ).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score"),
            "found"
        )
        shared.unpersist()
        out = found if out is None else out.unionByName(found)
    if out is None:
        null = F.lit(0).cast("long")
        out = docs.limit(0).select(F.col("doc_id").alias("query_id"), null.alias("rank"), "doc_id", F.lit(0.0).alias("score"))
    return out
