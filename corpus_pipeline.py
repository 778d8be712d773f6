"""Corpus preparation: five stages over ``documents``, each a function of (spark, docs, sf_dir)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import common, decontam, langid, lines, minhash, pieces


# Every stage takes null, empty and very long texts, null doc_ids, repeated rows, empty tables and further columns of any name. What
# becomes of them is said below; other columns come through as they are.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter (null and empty texts too) and those far from every language; repeated rows each by itself."""
    return langid.known(docs, langid.train(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes repeated passages of lines from the texts; every row stays, n_chars follows its text. A text of which four fifths or more
    would go is a copy of other documents: it stays whole for the next stage, which drops copies, so that no husks are left. Null and
    empty texts stay as they are."""
    count = "n_removed"
    while count in {c.lower() for c in docs.columns}:
        count += "_"
    out = lines.dedup(docs, whole=lines.WHOLE, count=count)
    made = F.when(F.col(count) > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return out.select(*(made.alias(c) if c == "n_chars" else F.col(common.quoted(c)) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five-word shingles, similarity 0.8), the one with the smallest doc_id; of
    rows with equal doc_id and text one. Texts without words and rows without doc_id stay."""
    return minhash.representatives(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark; null and empty texts stay, repeated rows go or stay together."""
    return decontam.clean(docs, common.table(spark, sf_dir, "benchmark"))


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts, a row for each row: the columns of documents, n_tokens, ids (little-endian unsigned 32-bit) and decoded_same
    (the ids decode to the text). Null text is encoded as the empty one. Columns that have these three names already are replaced."""
    prefix = "made_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    out = pieces.encode(docs, model, keep=tuple(docs.columns), prefix=prefix)
    same = F.col(f"{prefix}decoded") == F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = {"n_tokens": F.col(f"{prefix}n_tokens"), "ids": F.col(f"{prefix}ids"), "decoded_same": same}
    names = [*docs.columns, *(c for c in made if c not in {x.lower() for x in docs.columns})]
    return out.select(*(made.get(c.lower(), F.col(common.quoted(c))).alias(c) for c in names))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

#: Language identification and MinHash have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, read = common.table(spark, sf_dir, "documents"), lambda: None
    for name, stage in STAGES:
        docs, done = common.passed(stage(spark, docs, sf_dir), name)
        read()  # the stage before is whole in this one's table
        read = done
    return docs
