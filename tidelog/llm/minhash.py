"""Near-duplicate detection with circulant MinHash, banding and exact Jaccard verification.

Signature: a shingle's 64-bit fingerprint is put on a ring of 2^32 places by a first permutation (sigma); coordinate k is
the least value of a second permutation (pi) over those places shifted round the ring by k. So two permutations make
every coordinate. The signature keeps the low 16 bits of each.

Plan: equal shingle sets are one node (exact copies meet in a partial aggregate, never in pairs). Nodes that share a band
are linked to the least node of that bucket only; links are confirmed on full sets and joined to components. A second
round then takes the buckets in which several components are left: what they connect is a group. The full sets of all members that
are not of its largest component are compared with all others, in blocks of a bounded size, by lists of the owners of each shingle;
of the links found, those that join components are given. No link between components is lost and no group is expanded into its
pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

HASHES = 128
#: Probability with which banding may miss a pair exactly at the threshold.
MISS = 1e-6
#: A group's members are verified in slices of this many, each against the group's first.
SLICE = 256
#: Members of a group are compared across components in blocks of about so many, or of about so many shingles.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Texts are looked up by a broadcast of at most this many ids (under 50 bytes each with their places); beyond it, by a shuffle.
BROADCAST_IDS = 200_000

_SIGMA = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, hashes: int = HASHES, miss: float = MISS) -> tuple[int, int]:
    """(bands, rows): the most rows a band whose chance to miss a pair at ``threshold`` stays under ``miss``."""
    for rows in range(hashes, 0, -1):
        if (1 - threshold**rows) ** (hashes // rows) <= miss:
            return hashes // rows, rows
    return hashes, 1


def words_of(text: str | None) -> list[bytes]:
    """Lower-cases A-Z only; words are runs of bytes other than space and U+0009 to U+000D."""
    return (text or "").encode().lower().split()


def shingle_set(words: list[bytes], width: int, known: dict[bytes, int]) -> np.ndarray:
    """Sorted 64-bit fingerprints of the distinct shingles; with fewer words than ``width``, of the whole sequence."""
    if not words:
        return np.empty(0, np.uint64)
    get, digest = known.get, xxhash.xxh3_64_intdigest
    ids = [get(w) for w in words]
    if None in ids:
        if len(known) > 300_000:
            known.clear()
        for i, x in enumerate(ids):
            if x is None:
                ids[i] = known[words[i]] = digest(words[i])
    x = np.array(ids, dtype=np.uint64)
    width = min(width, len(x))
    n = len(x) - width + 1
    h = np.full(n, width, np.uint64)
    for i in range(width):
        h = (h ^ x[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Circulant MinHash coordinates of a non-empty set, low 16 bits of each."""
    place = (shingles ^ (shingles >> np.uint64(29))) * _SIGMA
    place = (place >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(hashes, dtype=np.uint32)[:, None]
    least = np.full(hashes, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(place), 512):
        x = place[None, at : at + 512] + shift
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(axis=1), out=least)
    return least.astype(np.uint16)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, set_id (128-bit digest of the set, null if empty), sig (16 bits a coordinate)."""

    def make():
        known: dict[bytes, int] = {}

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, ids, sigs = [], [], []
            for text in batch.column("text"):
                s = shingle_set(words_of(text.as_py()), width, known)
                sizes.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).tobytes() if len(s) else None)
            return pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary()),
                    pa.array(sigs, pa.binary())
                ],
                ["doc_id", "key", "n_shingles", "set_id", "sig"]
            )

        return each

    text = F.col("text").cast("string")
    return common.by_batch(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("key")), make,
        "doc_id long, key long, n_shingles long, set_id binary, sig binary"
    )


def _buckets(nodes: DataFrame, bands: int, rows: int, *more: str) -> DataFrame:
    """A row for each node and band: bucket (hash of the band and its coordinates)."""
    wide = 2 * rows
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.expr("sig").substr(i * wide + 1, F.lit(wide))))
    return nodes.select("node", *more, F.explode(keys).alias("bucket"))


def _likely(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """Pairs (a, b) whose whole signatures agree in at least ``floor`` of the coordinates."""
    sig = nodes.select("node", "sig")
    wide = pairs.join(
        sig.select(F.col("node").alias("a"), F.col("sig").alias("sig_a")), "a"
    ).join(sig.select(F.col("node").alias("b"), F.col("sig").alias("sig_b")), "b")

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
            return batch.select(["a", "b"]).filter(pa.array((x == y).mean(axis=1) >= floor))

        return each

    return common.by_batch(wide.select("a", "b", "sig_a", "sig_b"), make, "a long, b long")


def _spanning(sets: list[np.ndarray], comp: np.ndarray, left: np.ndarray, right: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Index pairs (one of left, one of right) that are links, as many as join the components that they can join. A shingle's
    owners are listed once; a row's intersections with all others are sums over the owners of its shingles."""
    size = np.array([len(s) for s in sets])
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), size)
    order = np.argsort(values, kind="stable")
    fresh = np.concatenate([[True], np.diff(values[order]) != 0])
    starts = np.flatnonzero(fresh)
    widths = np.diff(np.append(starts, len(values)))
    column = np.empty(len(values), np.int64)
    column[order] = np.cumsum(fresh) - 1
    owners, at = owner[order], np.concatenate([[0], np.cumsum(size)])
    top = {c: c for c in comp.tolist()}

    def root(c: int) -> int:
        while top[c] != c:
            top[c] = c = top[top[c]]
        return c

    for i in left:
        mine = column[at[i] : at[i + 1]]
        mine = mine[widths[mine] > 1]
        both = np.zeros(len(sets), np.int64)
        for few in np.array_split(mine, 1 + int(widths[mine].sum()) // 4_000_000):
            w = widths[few]
            flat = np.repeat(starts[few] - np.cumsum(w) + w, w) + np.arange(w.sum())
            both += np.bincount(owners[flat], minlength=len(sets))
        both = both[right]
        for j in right[(100 * both >= least * (size[right] + size[i] - both)) & (right != i)]:
            x, y = root(int(comp[i])), root(int(comp[j]))
            if x != y:
                top[max(x, y)] = min(x, y)
                yield i, j


def _blocks(members: DataFrame) -> DataFrame:
    """Adds to members (node, component, grp, n_shingles) their block: of the group's largest component (large) or of the others, each
    cut into blocks of about BLOCK members or BLOCK_SHINGLES shingles, and the numbers of both kinds of blocks (larges, smalls)."""
    sizes = members.groupBy("grp", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    best = sizes.groupBy("grp").agg(
        F.max_by("component", F.struct("n", -F.col("component"))).alias("most"), F.sum("n").alias("all_n"), F.sum("s").alias("all_s"),
        F.max_by(F.struct("n", "s"), F.struct("n", -F.col("component"))).alias("l")
    )
    cut = lambda n, s: F.greatest(F.ceil(n / BLOCK), F.ceil(s / BLOCK_SHINGLES)).cast("int")
    best = best.select(
        "grp", "most", cut(F.col("l.n"), F.col("l.s")).alias("larges"),
        cut(F.col("all_n") - F.col("l.n"), F.col("all_s") - F.col("l.s")).alias("smalls")
    )
    large = F.col("component") == F.col("most")
    block = F.pmod(F.xxhash64("node"), F.when(large, F.col("larges")).otherwise(F.col("smalls"))).cast("int")
    return members.join(best, "grp").select("node", "component", "grp", large.alias("large"), block.alias("block"), "larges", "smalls")


def _dealt(members: DataFrame) -> DataFrame:
    """node, to (grp, bi, bj, block, component): each member for each pair of blocks (bi, bj) that it takes part in."""
    far = 1 << 30  # blocks of the largest component are numbered from here
    pair = lambda x, y: F.struct(x.cast("int").alias("bi"), y.cast("int").alias("bj"))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.col("block")
    of_large = F.transform(upto("smalls"), lambda i: pair(i, own + far))
    of_small = F.concat(
        F.transform(upto("larges"), lambda i: pair(own, i + far)),
        F.transform(upto("smalls"), lambda i: pair(F.least(own, i), F.greatest(own, i)))
    )
    dealt = _blocks(members).select(
        "node", "component", "grp", F.when(F.col("large"), own + far).otherwise(own).alias("place"),
        F.explode(F.when(F.col("large"), of_large).otherwise(of_small)).alias("at")
    )
    return dealt.select("node", F.struct("grp", "at.bi", "at.bj", F.col("place").alias("block"), "component").alias("to"))


def _across(docs: DataFrame, members: DataFrame, width: int, least: int) -> DataFrame:
    """Links (a, b) between components within a group: members has node, component, grp, n_shingles. Members of a group's largest component
    need no comparison with each other: each block of the others is compared with each of its blocks and with each other such block, by
    the full sets of all their members, in one task. So a few strays beside a large component cost about as much as that is long."""
    dealt = _dealt(members)
    texts = _with_text(docs, dealt, members.count()).select("doc_id", "text", "to.*").repartition("grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        held: dict[int, tuple] = {}
        last = None

        def flush() -> pa.RecordBatch:
            ids, comp, block, sets = np.array(list(held)), *zip(*held.values(), strict=True)
            comp, block = np.array(comp), np.array(block)
            every = np.arange(len(ids))
            left, right = (every, every) if last[1] == last[2] else (every[block == last[1]], every[block == last[2]])
            found = [(ids[i], ids[j]) for i, j in _spanning(list(sets), comp, left, right, least)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([f(x) for x in found], pa.int64()) for f in (min, max)], ["a", "b"])

        for batch in batches:
            for doc, text, *key, block, comp in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "text", "grp", "bi", "bj", "block", "component")), strict=True
            ):
                if key != last:
                    if held:
                        yield flush()
                    last = key
                held[doc] = comp, block, shingle_set(words_of(text), width, known)
        if held:
            yield flush()

    return common.stored(texts.mapInArrow(run, "a long, b long"), "links")


def _with_text(docs: DataFrame, need: DataFrame, rows: int) -> DataFrame:
    """doc_id, text and each ``to`` of need (node, to)."""
    need = F.broadcast(need) if rows <= BROADCAST_IDS else need
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(need, F.col("doc_id") == F.col("node")).select("doc_id", "text", "to")


def _verified(docs: DataFrame, pairs: DataFrame, width: int, least: int) -> DataFrame:
    """Of pairs (a, b), those with 100 * intersection >= least * union on the full sets. The texts of a's partners come to
    a in slices of at most about SLICE, each with one copy of a's text."""
    pairs = common.stored(pairs, "pairs")
    slices = common.stored(
        pairs.groupBy("a").agg(F.count("*").alias("n")).select("a", F.ceil(F.col("n") / SLICE).cast("long").alias("n")), "slices"
    )
    firsts = slices.select(
        F.col("a").alias("doc_id"), F.col("a").alias("grp"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slice"),
        F.lit(True).alias("first")
    )
    others = pairs.join(slices, "a").select(
        F.col("b").alias("doc_id"), F.col("a").alias("grp"), F.pmod(F.xxhash64("b"), F.col("n")).alias("slice"), F.lit(False).alias("first")
    )
    need = firsts.unionByName(others).select(F.col("doc_id").alias("node"), F.struct("grp", "slice", "first").alias("to"))
    texts = _with_text(docs, need, 2 * pairs.count()).select("doc_id", "text", "to.*")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        key, own = None, []
        for batch in batches:
            a, b = [], []
            for doc, text, grp, part, first in zip(
                *(batch.column(c).to_pylist() for c in ("doc_id", "text", "grp", "slice", "first")), strict=True
            ):
                if (grp, part) != key:
                    key, own = (grp, part), []
                s = shingle_set(words_of(text), width, known)
                if first:
                    own.append(s)
                    continue
                for x in own:
                    both = len(np.intersect1d(x, s, assume_unique=True))
                    if 100 * both >= least * (len(x) + len(s) - both):
                        a.append(grp)
                        b.append(doc)
                        break
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = texts.repartition("grp", "slice").sortWithinPartitions("grp", "slice", F.desc("first"))
    return common.stored(dealt.mapInArrow(run, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs`` (doc_id, text; other columns are ignored)."""
    return classes(docs, width, percent).drop("key")


def classes(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, key (hash of the text), n_shingles, component_id, kept for each row of ``docs``.

    Documents are linked if 100 * intersection >= percent * union of their sets of distinct ``width``-word shingles (with
    fewer words, the whole sequence is the one shingle); component_id is the smallest doc_id reachable over links.

    Null or empty text, or text without words: an empty set, n_shingles 0, linked with nothing. Null doc_id: compared with
    nothing, component_id null, kept. doc_id names a document: rows of one doc_id each give a row, by their own text. Texts of any
    length are compared whole. An empty table gives no rows.
    """
    bands, rows = bands_for(percent / 100)
    floor = percent / 100 - 4.75 * math.sqrt(percent / 100 * (1 - percent / 100) / HASHES)
    all_docs = common.stored(sketches(docs, width), "sketches")
    sets = all_docs.where("set_id is not null and doc_id is not null")
    nodes = common.stored(
        sets.groupBy("set_id").agg(
            F.min("doc_id").alias("node"), F.min_by("sig", "doc_id").alias("sig"), F.max("n_shingles").alias("n_shingles")
        ),
        "nodes"
    )

    n = nodes.count()

    member = _buckets(nodes, bands, rows, "n_shingles")
    # what is joined back to a possibly hot bucket is stored first, so that the join's sides are shuffles that Spark can split
    first = member.groupBy("bucket").agg(
        F.min("node").alias("a"), F.min_by("n_shingles", "node").alias("n"), F.count("*").alias("size")
    ).where("size > 1").drop("size")
    first = common.stored(first, "first", n * bands)
    pairs = member.join(first, "bucket").where(
        f"a <> node and 100 * least(n, n_shingles) >= {percent} * greatest(n, n_shingles)"
    ).select("a", F.col("node").alias("b")).distinct()
    links = _verified(docs, _likely(pairs, nodes, floor), width, percent)
    parts = common.stored(common.components(links), "components", n)

    comp = nodes.select("node", "sig", "n_shingles").join(parts, "node", "left").select(
        "node", "sig", "n_shingles", F.coalesce("component", "node").alias("component")
    )
    member = _buckets(comp, bands, rows, "component", "n_shingles")
    open_ = member.groupBy("bucket").agg(
        F.min("node").alias("a"), F.min("component").alias("lo"), F.max("component").alias("hi")
    ).where("lo <> hi").select("bucket", "a")
    open_ = common.stored(open_, "buckets", n * bands)
    left = common.stored(member.join(open_, "bucket").select("a", "node", "component", "n_shingles").distinct(), "open", n * bands)
    groups = common.components(left.select("a", F.col("node").alias("b"))).withColumnRenamed("component", "grp")
    members = common.stored(left.select("node", "component", "n_shingles").distinct().join(groups, "node"), "members", n)
    more = _across(docs, members, width, percent)
    if not more.isEmpty():
        parts = common.stored(common.components(links.unionByName(more)), "components", n)

    final = nodes.select("set_id", "node").join(parts, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    out = all_docs.select("doc_id", "key", "n_shingles", "set_id").join(final, "set_id", "left")
    cid = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select(
        "doc_id", "key", "n_shingles", cid.alias("component_id"), F.coalesce(F.col("doc_id") == cid, F.lit(True)).alias("kept")
    )


def representatives(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` (all columns, whatever their names) that stay: of each group of near-duplicates the document with the
    smallest doc_id. Of rows with equal doc_id and text one stays; rows of one doc_id with different texts stay or go each by its
    own text. Rows with a null doc_id, null text or no words stay."""
    text = F.col("text").cast("string")
    stay = classes(docs, width, percent).where("kept and doc_id is not null").select(
        F.col("doc_id").alias("id"), F.col("key").alias("own")
    ).distinct()
    rows = docs.select(
        F.struct(*map(common.quoted, docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("key")
    )
    named = rows.join(stay, (F.col("doc") == F.col("id")) & (F.col("key") == F.col("own")), "left_semi").dropDuplicates(["doc", "key"])
    return named.unionByName(rows.where("doc is null")).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))
