"""Quality by ordinal cumulative-link regression on graded ratings.

A text is the set of its hashed words, runs of marks and stems. One weight vector serves all grades: P(grade >= j) is the logistic of
the text's score less the threshold of j, thresholds in ascending order. From these tail probabilities follow the expected
grade and the selection. The ratings are 0 for toxic, 1 for low quality, 2 for good.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 1 << 18
#: Rated texts that the model is fitted on (those with the least hash of doc_id), at most; texts of them that a word is in, at least.
SAMPLE, LEAST = 6_000, 5
STEPS, RATE, RIDGE = 600, 0.05, 2e-4
#: Words are used whose texts' mean grade is at least so many standard errors off the mean of all.
SCREEN = 3.5
GRADES = 3
#: Letters of a stem, and times from which it counts as repeated.
STEM, REPEATED = 5, 3
_tokens = re.compile(r"\w+|[^\w\s]+").findall
#: Runs of letters that are all capitals, by which shouting is told.
_LOUD, _CALM = SIZE - 1, SIZE - 2


def features(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Sorted buckets of a whole text: its distinct words and runs of marks, the first letters of its long words, which of those it
    repeats, and whether most of its letters are capitals."""
    if not text:
        return np.empty(0, np.int64)
    low = text.lower()
    words = _tokens(low)
    stems = Counter([w[:STEM] for w in words if len(w) > STEM])
    out = []
    for kind, some in (("w ", set(words)), ("s ", stems), ("r ", [x for x, n in stems.items() if n >= REPEATED])):
        for w in some:
            w = kind + w
            i = known.get(w)
            if i is None:
                if len(known) > 300_000:
                    known.clear()
                i = known[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) % (SIZE - 2)
            out.append(i)
    upper = sum(map(text.count, "AEINRST")) * 2 > sum(map(low.count, "aeinrst"))
    return np.unique(np.array([*out, _LOUD if upper else _CALM], np.int64))


class Model:
    """weights of the buckets, ascending thresholds of the grades from 1."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, found: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j from 1."""
        score = self.weights[found].sum()
        return 1 / (1 + np.exp(np.clip(self.thresholds - score, -50, 50)))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int = GRADES) -> Model:
    """Maximum likelihood with a ridge, by Adam on all rows. Without rows every grade is as likely."""
    thresholds = np.linspace(-0.5, 0.5, levels - 1)
    weights = np.zeros(SIZE)
    if not rows:
        return Model(weights, thresholds)
    n = np.array([len(r) for r in rows])
    flat = np.concatenate(rows)
    df = np.bincount(flat, minlength=SIZE)
    off = np.bincount(
        flat, weights=np.repeat(grades - grades.mean(), n), minlength=SIZE
    ) / np.sqrt(np.maximum(df, 1)) / max(grades.std(), 1e-9)
    keep = ((df >= min(LEAST, max(1, len(rows) // 20))) & (np.abs(off) >= SCREEN))[flat]
    row, col = np.repeat(np.arange(len(rows)), n)[keep], flat[keep]
    used, col = np.unique(col, return_inverse=True)
    w, gap = np.zeros(len(used)), np.zeros(levels - 1)
    share = np.array([max(1e-3, min(1 - 1e-3, np.mean(grades >= j))) for j in range(1, levels)])
    start = np.log((1 - share) / share)
    # thresholds: the first, then steps that stay positive as exponentials
    gap[0], gap[1:] = start[0], np.log(np.maximum(np.diff(start), 0.05))
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (w, gap)]
    for t in range(1, STEPS + 1):
        b = np.concatenate([gap[:1], gap[0] + np.cumsum(np.exp(gap[1:]))])
        score = np.bincount(row, weights=w[col], minlength=len(rows))
        tail = np.concatenate(
            [np.ones((len(rows), 1)), 1 / (1 + np.exp(np.clip(b - score[:, None], -50, 50))), np.zeros((len(rows), 1))], axis=1
        )
        at = np.arange(len(rows))
        p = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-9)
        slope = tail * (1 - tail)
        d_score = (slope[at, grades] - slope[at, grades + 1]) / p / len(rows)
        d_b = np.zeros(levels - 1)
        for j in range(1, levels):
            d_b[j - 1] = (-(slope[:, j] / p)[grades == j].sum() + (slope[:, j] / p)[grades == j - 1].sum()) / len(rows)
        g_w = np.bincount(col, weights=d_score[row], minlength=len(used)) - RIDGE * w
        g_gap = np.concatenate([[d_b.sum()], np.exp(gap[1:]) * np.cumsum(d_b[::-1])[::-1][1:]])
        for x, g, m in ((w, g_w, moments[0]), (gap, g_gap, moments[1])):
            m[0][:] = 0.9 * m[0] + 0.1 * g
            m[1][:] = 0.999 * m[1] + 0.001 * g * g
            x += RATE * (m[0] / (1 - 0.9**t)) / (np.sqrt(m[1] / (1 - 0.999**t)) + 1e-8)
    weights[used] = w
    return Model(weights, np.concatenate([gap[:1], gap[0] + np.cumsum(np.exp(gap[1:]))]))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on at most SAMPLE rated texts. labels: doc_id, quality 0/1, toxic 0/1; of several ratings of a text the greatest of each
    count, a null is 0. Ratings of unknown or null doc_ids are skipped; of rows with one doc_id the least text counts, once."""
    rated = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max("quality"), F.lit(0)).alias("quality"), F.coalesce(F.max("toxic"), F.lit(0)).alias("toxic")
    )
    rated = rated.select("doc_id", F.when(F.col("toxic") > 0, 0).when(F.col("quality") > 0, 2).otherwise(1).cast("int").alias("grade"))
    # the least hashes are all under a threshold that leaves at least SAMPLE rows: only those are sorted
    rated = rated.withColumn("hash", F.xxhash64("doc_id"))
    under = rated.where(F.col("hash") < min(2**63 - 1, -(2**63) + int(4 * SAMPLE / max(rated.count(), 1) * 2**64)))
    some = (under if under.count() >= SAMPLE else rated).orderBy("hash", "doc_id").limit(SAMPLE).drop("hash")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("grade"),
                    pa.array([features(t.as_py(), known).astype("<i4").tobytes() for t in batch.column("text")], pa.binary())
                ],
                ["grade", "found"]
            )

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).join(F.broadcast(some), "doc_id")
    texts = texts.groupBy("doc_id", "grade").agg(F.min("text").alias("text"))
    got = sorted((r.grade, bytes(r.found)) for r in texts.select("grade", "text").mapInArrow(run, "grade int, found binary").collect())
    return fit([np.frombuffer(f, "<i4").astype(np.int64) for _, f in got], np.array([g for g, _ in got], int))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_grade (0 to 2), p_usable (P(grade >= 1)), p_good (P(grade >= 2)), kept (p_usable >= 0.5) for each row.

    Null, empty and blank texts have no words and get what the thresholds alone give. Null doc_ids and repeated rows are kept as
    they are; an empty table gives no rows. Whole texts are read, of any length; other columns, whatever their names, are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            p = np.array([shared.value.tails(features(t.as_py(), known)) for t in batch.column("text")]).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(p[:, 0] >= 0.5)],
                ["doc_id", "expected_grade", "p_usable", "p_good", "kept"]
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, "doc_id long, expected_grade double, p_usable double, p_good double, kept boolean")
