"""Benchmark decontamination by the q-gram lemma.

A passage is a window of a benchmark item. Texts and items are compared in a normal form (lower case, runs of white space one
space); a passage of L characters is found where a text's region is within k edits of it. By the q-gram lemma such a region
shares at least L - Q + 1 - k * Q of the passage's q-grams, on diagonals that lie within k of each other. Shared q-grams are
counted in overlapping bands of diagonals; bands that reach the bound are verified by banded alignment. Besides, every run of RUN
characters or more that an item and a text have in common is found, wherever in the item it stands: the q-grams of passages are all
of the item's, and such a run is RUN - Q + 1 neighbouring ones on one diagonal. Shorter or edited parts of an item that hold no
passage within the edits are not found. An item under Q characters is found where a text is nothing else.

The q-grams of a text are taken in slices that overlap by more than a region, and the passages in ranges, so that what is expanded at
once stays under EXPANDED however many passages share a q-gram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

Q = 10
#: Characters of a passage, and from one's start to the next's; an item that is shorter is one passage.
LENGTH, STEP = 64, 32
#: Characters from which on any verbatim part of an item is found.
RUN = 52
#: Edits allowed, as a share of a passage's length (fewer where the lemma's bound would be under 1).
SHARE = 0.08
#: Characters of items that are sent to the tasks at once; larger benchmarks are taken in blocks.
BLOCK_CHARS = 4_000_000
#: Shared q-grams of a slice, and pairs of such a q-gram and a place in a passage that are held at once.
SLICE, EXPANDED = 8192, 2_000_000
_MUL = np.uint64(0x9E3779B97F4A7C15)
_tables: list[tuple[np.ndarray, np.ndarray]] = []


def _chars() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        low = np.arange(0x110000, dtype=np.uint32)
        for i in range(0x20000):
            c = chr(i).lower()
            if len(c) == 1:
                low[i] = ord(c)
        _tables.append((low, np.fromiter((chr(i).isspace() for i in range(0x110000)), bool, 0x110000)))
    return _tables[0]


def normal(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(code points in normal form, place of each in the text)."""
    low, space = _chars()
    x = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    if not len(x):
        return x, np.empty(0, np.int64)
    blank = space[x]
    keep = ~blank | np.concatenate([[False], ~blank[:-1]])
    places = np.flatnonzero(keep)
    return np.where(blank, np.uint32(32), low[x])[places], places


def grams(x: np.ndarray) -> np.ndarray:
    """Hash of the Q characters from each place, by doubling."""
    h, n, out, at, left = x.astype(np.uint64), 1, None, 0, Q
    while left:
        if left & 1:
            out = h if out is None else _join(out, at, h, n)
            at += n
        left >>= 1
        if left:
            h = _join(h, n, h, n)
            n *= 2
    return (out ^ (out >> np.uint64(31))) * _MUL


def _join(a: np.ndarray, n: int, b: np.ndarray, m: int) -> np.ndarray:
    """Hashes of n + m characters from those of n and of the m that follow."""
    size = max(0, min(len(a), len(b) - n))
    return a[:size] * np.uint64(pow(int(_MUL), m, 1 << 64)) + b[n : n + size]


class Index:
    """Passages of some items: their q-grams, sorted, with passage and place."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.text, self.k = [], [], []
        self.whole, whole, start = [], [], []
        self.short: dict[str, list[int]] = {}
        hashes, owners, places = [], [], []
        for item, text in items:
            x, _ = normal(text or "")
            x = x[1:] if len(x) and x[0] == 32 else x
            x = x[:-1] if len(x) and x[-1] == 32 else x
            if 0 < len(x) < Q:
                self.short.setdefault(x.tobytes().decode("utf-32-le", "replace"), []).append(item)
            last = max(0, len(x) - LENGTH)
            for at in sorted({*range(0, last + 1, STEP), last}) if len(x) >= Q else ():
                piece = x[at : at + LENGTH]
                h = grams(piece)
                hashes.append(h)
                owners.append(np.full(len(h), len(self.item), np.int64))
                places.append(np.arange(len(h), dtype=np.int64))
                whole.append(len(self.whole))
                start.append(at)
                self.item.append(item)
                self.text.append(piece.tobytes().decode("utf-32-le", "replace"))
                self.k.append(max(0, min(int(SHARE * len(piece)), (len(piece) - Q) // Q)))
            self.whole.append((item, x))
        self.of, self.start = np.array(whole, np.int64), np.array(start, np.int64)
        self.longest = max((len(x) for _, x in self.whole), default=0)
        self.k = np.array(self.k, np.int64)
        size = np.array([len(t) for t in self.text], np.int64)
        self.need = size - Q + 1 - self.k * Q
        every = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.hashes, first = np.unique(every[order], return_index=True)
        self.first = np.append(first, len(every))
        self.owner = np.concatenate(owners)[order] if hashes else np.empty(0, np.int64)
        self.place = np.concatenate(places)[order] if hashes else np.empty(0, np.int64)
        # (q-gram, passage) as one number, in order, so that a range of passages is a range of each q-gram's postings
        self.code = np.repeat(np.arange(len(self.hashes)), np.diff(self.first)) * max(1, len(self.item)) + self.owner
        bits = max(16, int(len(self.hashes) * 16).bit_length())
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.hashes >> self.shift] = True
        self.width = int(self.k.max(initial=0)) + 1

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, begin, end, distance) for each item of which a passage is in the text: its nearest region, then the first; begin
        and end are code points of the text."""
        best: dict[int, tuple[int, int, int]] = {}
        for item, begin, end, distance, run in sorted(self._found(text), key=lambda r: r[4]):
            new = (distance, begin, end)
            # a run only where no passage is near
            if item not in best or new < best[item] and not (run and best[item][0]):
                best[item] = new
        return sorted((item, begin, end, distance) for item, (distance, begin, end) in best.items())

    def regions(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, begin, end, distance) of every region of the text that passages of an item and common runs cover without a gap; distance is
        the least of theirs, a run's is 0."""
        out: list[tuple[int, int, int, int]] = []
        for item, begin, end, distance, _ in sorted(self._found(text)):
            if out and out[-1][0] == item and begin <= out[-1][2]:
                out[-1] = (item, out[-1][1], max(out[-1][2], end), min(out[-1][3], distance))
            else:
                out.append((item, begin, end, distance))
        return out

    def _found(self, text: str | None) -> list[tuple[int, int, int, int, bool]]:
        """As ``regions``, with what is a run and not a passage."""
        if not text:
            return []
        x, places = normal(text)
        if len(x) < Q + 2 and self.short:
            plain = x.tobytes().decode("utf-32-le", "replace")
            if items := self.short.get(plain.strip(" ")):
                begin = len(plain) - len(plain.lstrip(" "))
                return [(item, int(places[begin]), int(places[begin + len(plain.strip(" ")) - 1]) + 1, 0, False) for item in items]
        if len(x) < Q or not len(self.hashes):
            return []
        h = grams(x)
        at = np.flatnonzero(self.maybe[h >> self.shift])
        slot = np.searchsorted(self.hashes, h[at])
        slot[slot == len(self.hashes)] = 0
        same = self.hashes[slot] == h[at]
        at, slot = at[same], slot[same]
        if not len(at):
            return []
        exact: dict[tuple[int, int], list[tuple[int, int]]] = {}
        found: set[tuple[int, int, int, int, bool]] = set()
        plain = None
        for owner, diagonal, where in self._expanded(x, at, slot):
            band = (diagonal + LENGTH) // self.width + 1
            span = (len(x) + LENGTH) // self.width + 3
            # bands j cover diagonals of the cells j and j + 1
            keys, counts = np.unique(np.concatenate([owner * span + band, owner * span + band - 1]), return_counts=True)
            who, cell = np.divmod(keys, span)
            good = counts >= self.need[who]
            for p, b in zip(who[good].tolist(), cell[good].tolist(), strict=True):
                if plain is None:
                    plain = x.tobytes().decode("utf-32-le", "replace")
                lo = (b - 1) * self.width - LENGTH
                got = align(self.text[p], plain, lo, lo + 2 * self.width - 1, int(self.k[p]))
                if got:
                    distance, begin, end = got
                    found.add((self.item[p], begin, end, distance, False))
            for item, begin, end, shift in where:
                exact.setdefault((item, shift), []).append((begin, end))
        whole: dict[int, list[tuple[int, int]]] = {}
        for (item, _), parts in exact.items():  # parts of a run from several slices are one
            own = whole.setdefault(item, [])
            top = None
            for begin, end in sorted(parts):
                if top and begin <= top[1]:
                    top = (top[0], max(top[1], end))
                    own[-1] = top
                else:
                    top = (begin, end)
                    own.append(top)
        for item, runs in whole.items():
            far = 0
            for begin, end in sorted(runs, key=lambda r: (r[0], -r[1])):  # of runs within one another the longest
                if end > far:
                    found.add((item, begin, end, 0, True))
                    far = end
        return [(item, int(places[begin]), int(places[end - 1]) + 1, distance, run) for item, begin, end, distance, run in found]

    def _expanded(
        self, x: np.ndarray, at: np.ndarray, slot: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]]:
        """(passage, diagonal, common runs) of the shared q-grams (place in the text, q-gram), at most about EXPANDED at once. Slices of the
        text overlap by more than a region and a run of RUN characters needs."""
        overlap = LENGTH + 2 * self.width + max(LENGTH, RUN) + Q
        first, passages = 0, max(1, len(self.item))
        while first < len(at):
            # q-grams of so many, and on to the end of the overlap
            last = min(len(at), first + SLICE)
            end = len(at) if last == len(at) else max(last, int(np.searchsorted(at, at[last - 1] + overlap, "right")))
            own, gram = at[first:end], slot[first:end]
            todo = [(0, passages)]
            while todo:
                lo, hi = todo.pop()
                a, b = np.searchsorted(self.code, gram * passages + lo), np.searchsorted(self.code, gram * passages + hi)
                n = b - a
                if n.sum() > EXPANDED and hi - lo > 1:
                    # passages of one item stay together where they can: its runs go over them
                    middle = (lo + hi) // 2
                    cut = int(np.searchsorted(self.of, self.of[middle]))
                    if lo < cut < hi:
                        todo += [(cut, hi), (lo, cut)]
                        continue
                    more = -(-(RUN + LENGTH) // STEP)
                    if hi - lo > 2 * more:
                        todo += [(middle, hi), (lo, middle + more)]
                        continue
                if not n.sum():
                    continue
                flat = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
                owner, place = self.owner[flat], self.place[flat]
                diagonal = np.repeat(own, n) - place
                yield owner, diagonal, list(self._runs(x, own, owner, diagonal, place))
            first = last

    def _runs(
        self, x: np.ndarray, at: np.ndarray, owner: np.ndarray, diagonal: np.ndarray, place: np.ndarray
    ) -> Iterator[tuple[int, int, int, int]]:
        """(item, begin, end, shift against the item) of the longest common parts of RUN characters or more, from the shared q-grams (places ``at`` of the
        text; passage, diagonal and place of each posting)."""
        n = RUN - Q + 1
        if len(at) < n or not (at[n - 1 :] - at[: len(at) - n + 1] == n - 1).any():
            return
        # equal items and diagonals are neighbours, in order of the place in the item
        wide, span = self.longest + 1, len(x) + self.longest + 1
        code = np.unique((self.of[owner] * span + diagonal - self.start[owner] + self.longest) * wide + self.start[owner] + place)
        cuts = np.flatnonzero(np.diff(code) != 1) + 1
        first, last = np.append(0, cuts), np.append(cuts, len(code)) - 1
        for a, b in zip(code[first].tolist(), code[last].tolist(), strict=True):
            if b - a + 1 >= n:
                rest, p = divmod(a, wide)
                of, d = divmod(rest, span)
                item, whole = self.whole[of]
                begin, size = d - self.longest + p, b - a + Q
                if np.array_equal(x[begin : begin + size], whole[p : p + size]):
                    yield item, begin, begin + size, begin - p


def align(passage: str, text: str, lo: int, hi: int, most: int) -> tuple[int, int, int] | None:
    """(distance, begin, end) of the region of ``text`` nearest to the passage, if within ``most`` edits, by alignment in the band
    of diagonals lo - most to hi + most. Ends in the text are free; of equal ones the first."""
    lo, hi = lo - most, hi + most
    at = text.find(passage, max(0, lo), max(0, hi + len(passage) + 1))
    if at >= 0:
        return 0, at, at + len(passage)
    far = most + 1
    width = hi - lo + 1
    # cell d of row i: the first i characters of the passage against the text up to place i + lo + d
    cost = [0 if 0 <= lo + d <= len(text) else far for d in range(width)]
    start = [lo + d for d in range(width)]
    for i, c in enumerate(passage):
        new, begin = [far] * width, [0] * width
        alive = False
        for d in range(width):
            j = i + 1 + lo + d
            if j < 0 or j > len(text):
                continue
            best, s = far, 0
            if j > 0 and cost[d] < far:
                v = cost[d] + (text[j - 1] != c)
                if v < best:
                    best, s = v, start[d]
            if d + 1 < width and cost[d + 1] + 1 < best:
                best, s = cost[d + 1] + 1, start[d + 1]
            if d and new[d - 1] + 1 < best:
                best, s = new[d - 1] + 1, begin[d - 1]
            if best < far:
                new[d], begin[d], alive = best, s, True
        if not alive:
            return None
        cost, start = new, begin
    best = min(range(width), key=lambda d: (cost[d], d))
    end = len(passage) + lo + best
    return (cost[best], start[best], end) if cost[best] < far and end > start[best] else None


def blocks(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of the items (item_id, text), each of at most about BLOCK_CHARS characters; at least one."""
    held, size, made = [], 0, False
    for row in benchmark.select(
        F.col("item_id").cast("long").alias("i"), F.col("text").cast("string").alias("t")
    ).where("i is not null and t is not null").orderBy("i", "t").toLocalIterator():
        if held and size + len(row.t) > BLOCK_CHARS and row.i != held[-1][0]:
            yield Index(held)
            held, size, made = [], 0, True
        held.append((row.i, row.t))
        size += len(row.t)
    if held or not made:
        yield Index(held)


def matches(docs: DataFrame, benchmark: DataFrame, every: bool = False) -> DataFrame:
    """doc_id, item_id, begin, end, distance for each row of ``docs`` (doc_id, text) and item that it holds a passage of, or RUN
    characters: the nearest region of a passage or run, of equal ones the first, in code points of the text. With ``every``, all regions,
    what overlaps as one with the least distance.

    Null texts and blank items match nothing; an item under Q characters matches a text that is nothing else (in normal form). Texts and
    items of any length are compared whole. Repeated rows repeat their matches, items with equal ids are one item; a null doc_id is
    kept, a null item_id left out; other columns, whatever their names, are ignored. Empty tables give no rows.
    """

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [
                    (doc, *m) for doc,
                    text in zip(
                        batch.column(0).to_pylist(), batch.column(1), strict=True
                    ) for m in (shared.value.regions if every else shared.value.find)(text.as_py())
                ]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 5)],
                    ["doc_id", "item_id", "begin", "end", "distance"]
                )

        found = picked.mapInArrow(run, "doc_id long, item_id long, begin long, end long, distance long")
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no passage of the benchmark nor RUN characters of an item; null texts are clean."""
    for index in blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        docs = common.filtered(docs, lambda shared=shared: lambda text: not shared.value.find(text))
    return docs
