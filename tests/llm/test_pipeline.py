import hashlib
import importlib.util
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tidelog.llm import decontam, langid, lines, queries

DIR = "/root/testdata/sf0.001"


def own(name):
    spec = importlib.util.spec_from_file_location(name, Path(__file__).with_name(f"{name}.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


line_brute, near_brute = own("test_lines_search").brute, own("test_near_dedup").brute


def norm(t):
    return " ".join(t.lower().split())


def brute_pipeline(docs, bench, model):
    """[(doc_id, text)] that are left, by comparing all with all."""
    rows = [(i, t) for i, t, _ in docs if not model.predict(t)[2]]
    rows = [(i, t) for i, (t, _) in line_brute(rows, lines.WHOLE).items()]
    comp = near_brute(rows, 5, 80)
    rows = [(i, t) for i, t in rows if comp[i][1] == i]
    passages = [p for _, t in bench for p in decontam.Index([(0, t)]).text]
    return sorted((i, t) for i, t in rows if not any(p in norm(t) for p in passages))


def test_pipeline_as_brute_force(spark, sample):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    bench = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    want = brute_pipeline(sample, bench, langid.train(docs))
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns == [*docs.columns, "n_tokens", "ids", "decoded_same"]
    got = sorted((r.doc_id, r.text, r.n_chars, r.n_tokens, bytes(r.ids), r.decoded_same) for r in out.collect())
    assert [x[:2] for x in got] == want and 0 < len(want) < len(sample)
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for _, text, n_chars, n, ids, same in got:
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)
        assert n == len(ids) // 4 and n_chars == len(text) and same


def test_stages_are_of_documents_form():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]
    assert entry.queries()["pipeline"].__wrapped__ is corpus_pipeline.run


def test_stages_stand_odd_rows(spark, docs, sample):
    """Nulls, empty and repeated rows, clashing columns and empty tables through every stage."""
    odd = docs(*sample[:40], (None, sample[1][1]), (900, None), (901, ""), (902, sample[3][1]), (902, sample[3][1]), (903, "!!"))
    odd = odd.withColumns({c: F.lit("x") for c in "component ids n_tokens decoded decoded_same begins made_ids n_removed key doc row gone __id __text rejected lang_pred".split()} | {"__none": F.lit(None).cast("string"), "a.b": F.lit(1)})
    odd = odd.unionByName(odd.where("doc_id = 900").withColumns({"doc_id": F.lit(905).cast("long"), "text": F.repeat(F.lit("Very long words of it. \nAnd a line\n"), 20_000)}))
    for name, stage in corpus_pipeline.STAGES:
        df = odd
        out = stage(spark, df, DIR)
        assert out.columns[: len(df.columns)] == df.columns
        n = out.count()
        assert 0 < n <= df.count() and (name not in ("line_dedup", "sentencepiece") or n == df.count())
        assert stage(spark, df.limit(0), DIR).isEmpty()


def test_no_husks(spark, docs):
    """Copies come to near-dedup whole; a passage within another document goes."""
    passage = "\n".join(f"passage line {i} with some words of its own" for i in range(10))
    own = lambda n: "\n".join(f"document {n} says this in line {i} and no other does so" for i in range(12))
    df = docs((1, f"{own(1)}\n{passage}"), (2, f"{own(2)}\n{passage}\n{own(22)}"), (3, f"{own(1)}\n{passage}"), (4, f"{own(1)}\n{passage}\nand a last line"))
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, DIR).collect()}
    assert got == {1: f"{own(1)}\n{passage}", 2: f"{own(2)}\n{own(22)}", 3: f"{own(1)}\n{passage}", 4: f"{own(1)}\n{passage}\nand a last line"}
    left = corpus_pipeline.near_dedup(spark, corpus_pipeline.line_dedup(spark, df, DIR), DIR)
    assert sorted(r.doc_id for r in left.collect()) == [1, 2]


def test_one_id_with_different_texts(spark, docs):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    got = corpus_pipeline.near_dedup(spark, docs((5, a), (5, b), (5, b), (3, a), (7, b)), DIR).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, a), (5, b)]


def test_op3_as_the_library(spark, sample):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in queries.op3_sentencepiece(spark, DIR).collect()}
    for i, t, _ in sample:
        ids = library.encode(t, add_bos=True, add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_op6_as_brute_force(spark, sample):
    want = near_brute([(i, t) for i, t, _ in sample], 3, 85)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op6_minhash_near_dedup(spark, DIR).collect()}
    assert got == want


def test_op8_as_plain_search(spark, sample):
    bench = [tuple(r) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    want = {(i, j) for i, t, _ in sample for j, b in bench if any(p in norm(t) for p in decontam.Index([(j, b)]).text)}
    got = {(r.doc_id, r.item_id) for r in queries.op8_decontamination(spark, DIR).where("distance = 0").collect()}
    assert got == want and want


@pytest.mark.parametrize("name", ["op4_quality", "op5_html_extraction", "op7_language_id", "op9_lm_score"])
def test_a_row_for_each_row(spark, name):
    table = "pages" if name.startswith("op5") else "documents"
    got = queries.QUERIES[name](spark, DIR)
    assert got.count() == spark.read.parquet(f"{DIR}/{table}.parquet").count() == got.select(got.columns[0]).distinct().count()
