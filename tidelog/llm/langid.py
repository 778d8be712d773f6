"""Language identification by nearest centroid.

A text is a TF-IDF vector of hashed character n-grams (one to three letters; runs of other characters are one space),
scaled to length 1. Each language has several centroids, found by spherical k-means on a bounded sample of its labelled
texts. The prediction is the language of the centroid with the greatest cosine; a text is rejected if that is under a share of
what a low quantile of the language's sampled texts have. A text of m n-grams, as part of one of M, has a cosine of about the root
of m / M with it; cosines are compared by that measure, so short texts are not rejected for their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

SIZE = 1 << 14
#: Labelled texts a language that the centroids are fitted on (those with the least hash of doc_id), at most.
SAMPLE = 400
#: Besides them: ten standard deviations of how many hashes are under a bound, and as much again for the sketch's error.
MORE = 300
CENTROIDS = 3
#: A text is rejected if its best cosine is under this share of the quantile LOW of the language's sampled texts.
MARGIN, LOW = 0.5, 0.05
_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(buckets, counts) of the n-grams of a whole text; None if it has no letter."""
    if not text:
        return None
    x = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = _is_letter()[x]
    if not letter.any():
        return None
    x = np.where(letter, x, np.uint32(32))
    x = x[np.concatenate([[True], letter[1:] | letter[:-1]])]
    x = np.concatenate([[32], x, [32]]).astype(np.uint32)
    h1 = x * np.uint32(0x9E3779B1)
    h2 = h1[:-1] * np.uint32(0x85EBCA6B) + x[1:] * np.uint32(0xC2B2AE35)
    h3 = h2[:-1] * np.uint32(0x27D4EB2F) + x[2:] * np.uint32(0x165667B1)
    total = np.zeros(SIZE, np.int64)
    for h in (h1, h2, h3):
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        total += np.bincount(h >> np.uint32(18), minlength=SIZE)
    at = np.flatnonzero(total)
    return at, total[at]


def _unit(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[at]
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


class Model:
    def __init__(self, langs: list[str], of: np.ndarray, centroids: np.ndarray, idf: np.ndarray, floors: list[float], typical: list[float]):
        self.langs, self.of, self.centroids, self.idf = langs, of, centroids, idf
        self.floors, self.typical = floors, typical

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language or und, cosine from 0 to 1, rejected)."""
        got = counts(text)
        if got is None or not self.langs:
            return "und", 0.0, True
        cos = self.centroids[got[0]].T @ _unit(*got, self.idf)
        best = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[best])))
        lang = self.of[best]
        return self.langs[lang], score, score < self.floors[lang] * min(1.0, len(got[0]) / self.typical[lang]) ** 0.5


def fit(samples: dict[str, list[tuple[np.ndarray, np.ndarray]]], k: int = CENTROIDS) -> Model:
    """samples: for each language the n-gram counts of its texts."""
    langs = sorted(x for x, rows in samples.items() if rows)
    rows = [r for x in langs for r in samples[x]]
    df = np.zeros(SIZE)
    for at, _ in rows:
        df[at] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    found, of, floors, typical = [], [], [], []
    for i, lang in enumerate(langs):
        x = np.zeros((len(samples[lang]), SIZE), np.float32)
        for j, (at, n) in enumerate(samples[lang]):
            x[j, at] = _unit(at, n, idf)
        c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
        for _ in range(10):
            near = np.argmax(x @ c.T, axis=1)
            for j in range(len(c)):
                if (near == j).any():
                    m = x[near == j].sum(axis=0)
                    c[j] = m / max(np.linalg.norm(m), 1e-12)
        sizes = np.array([len(at) for at, _ in samples[lang]], float)
        typical.append(float(np.median(sizes)))
        own = (x @ c.T).max(axis=1) / np.sqrt(np.minimum(1, sizes / typical[-1]))
        floors.append(MARGIN * min(1.0, float(np.quantile(own, LOW))))
        found.append(c)
        of += [i] * len(c)
    centroids = np.concatenate(found).T.copy() if found else np.zeros((SIZE, 0), np.float32)
    return Model(langs, np.array(of, int), centroids, idf, floors, typical)


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("long").cast("string")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame) -> Model:
    """Fits on labelled rows that are not held out; a null doc_id is not learned from. At most SAMPLE texts a language."""
    usable = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")
    )
    usable = usable.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    # ids and hashes only: a language of about n ids (counted by a sketch) keeps those under a hash that leaves SAMPLE of them and MORE
    # besides, then the SAMPLE least of these; so neither the count nor the choice sorts what a large language has
    ids = usable.select("doc_id", "lang", F.xxhash64("doc_id").alias("hash"))
    n = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.03).alias("n"))
    below = (F.col("hash") / F.lit(2.0**64) + 0.5) * F.col("n") < SAMPLE + MORE
    # (a row a language; the model, with centroids for each, goes to all tasks as well)
    ids = ids.join(F.broadcast(n), "lang").where(below).select("doc_id", "lang", "hash").distinct()
    ids = ids.withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy("hash", "doc_id"))
    ).where(F.col("rank") <= SAMPLE).select("doc_id", "lang")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (lang, got[0].astype("<i4").tobytes(), got[1].astype("<i8").tobytes()) for lang,
                text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True) if (got := counts(text))
            ]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.binary(), pa.binary()), strict=True)],
                    ["lang", "at", "n"]
                )

    samples: dict[str, list] = {}
    # of rows with one doc_id and language the least text, so that no more than the sample comes to the driver
    picked = usable.join(ids, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    picked = picked.select("lang", "text").mapInArrow(run, "lang string, at binary, n binary")
    for row in sorted(picked.collect(), key=lambda r: (r.lang, bytes(r.at), bytes(r.n))):
        samples.setdefault(row.lang, []).append((np.frombuffer(bytes(row.at), "<i4"), np.frombuffer(bytes(row.n), "<i8")))
    return fit({lang: rows[:SAMPLE] for lang, rows in samples.items()})


def predictions(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """Columns ``keep`` of each row, then lang_pred, score, rejected. Null text or text without letters: und, 0, rejected."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(zip(*(model.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()), strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()), pa.array(got[2], pa.bool_())],
                [*keep, "lang_pred", "score", "rejected"]
            )

    return docs.select(*keep, F.col("text").cast("string").alias("__text")).mapInArrow(
        run, f"{schema}, lang_pred string, score double, rejected boolean"
    )


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row of ``docs`` (doc_id, text, lang), learned from the rows that are
    not held out (crc32 of doc_id as text mod 3 is not 1) and have a language.

    lang_pred is a learned language; und if text is null or has no letter, or nothing could be learned. A null doc_id is not
    held out and not learned from. Repeated rows give a row each, and are learned from once; ties go to the first language in order
    of name. An empty table gives no rows. Whole texts are read, of any length; other columns, whatever their names, are ignored.
    """
    out = predictions(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs), "doc_id")
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")


def known(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` (all columns) that the model does not reject."""
    return common.filtered(docs, lambda: lambda text: not model.predict(text)[2])
