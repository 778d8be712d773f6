import hashlib
import math
import re
import time
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as proto

from tidelog.llm import common, langid, lm, pieces, quality, queries

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ENCODER = pieces.Encoder(pieces.load(MODEL))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\tab▁é日😀\u0000​"), st.characters(exclude_categories=("Cs",))), max_size=60))
def test_ids_spans_and_text_are_the_librarys(text):
    ids, begin, end = ENCODER.encode(text)
    want = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert ENCODER.decode(ids) == LIBRARY.decode(want)
    ids, begin, end = (np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(text, False))
    spans = [(p.begin, p.end) for p in LIBRARY.encode(text, return_type="proto").pieces if not p.piece.startswith("<0x")]
    own = [(b, e) for i, b, e in zip(ids, begin, end, strict=True) if not LIBRARY.is_byte(i)]
    assert own == spans
    assert not ids or (begin[0] == 0 and end[-1] == len(text.encode()) and begin[1:] == end[:-1])


def trie(entries):
    """A compiled character map of {key bytes: replacement bytes}: double-array units, built the plain way."""
    texts, at = b"", {}
    for k, v in entries.items():
        at[k] = len(texts)
        texts += v + b"\0"
    units = {0: 0}
    free = [1]

    def put(prefix, node):
        labels = sorted({k[len(prefix)] for k in entries if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in entries
        offset = (free[0] + 255) // 256 * 256 + 256
        free[0] = offset + 256
        base = node ^ offset
        units[node] = units.get(node, 0) | (offset >> 8 << 10 | 1 << 9 if offset >= 1 << 21 else offset << 10) | (1 << 8 if leaf else 0)
        if leaf:
            units[base] = at[prefix] | 1 << 31
        for c in labels:
            units[base ^ c] = c
        for c in labels:
            put(prefix + bytes([c]), base ^ c)

    put(b"", 0)
    size = (max(units) + 512) // 256 * 256
    raw = np.zeros(size, "<u4")
    for i, u in units.items():
        raw[i] = u
    blob = raw.tobytes()
    return len(blob).to_bytes(4, "little") + blob + texts


def test_longest_prefix_of_the_character_map():
    m = pieces.CharMap(trie({b"a": b"x", b"ab": b"yy", b"abcd": b"z", "é".encode(): b"e", b"\t": b" "}))
    find = lambda s, at=0: m.longest(s.encode(), at)
    assert find("abc") == (b"yy", 2) and find("abcd") == (b"z", 4) and find("ac") == (b"x", 1)
    assert find("é") == (b"e", 2) and find("b") is None and find("xab", 1) == (b"yy", 2)
    assert pieces.CharMap(b"").longest(b"a", 0) is None


def test_alignment_through_replacements():
    spec = proto.NormalizerSpec(precompiled_charsmap=trie({"ﬁ".encode(): b"fi", b"\t": b" ", "…".encode(): b"..."}), add_dummy_prefix=True, remove_extra_whitespaces=True, escape_whitespaces=True)
    out, source = pieces.Normalizer(spec, False)("\t ﬁx  …")
    assert out.decode() == "▁fix▁..."
    # the dummy prefix and both letters of the ligature come from the place of the ligature
    assert source.tolist() == [2, 2, 2, 2, 2, 5, 6, 6, 6, 8, 8, 8, 11]
    assert pieces.Normalizer(spec, False)(" \t ") [0] == b""


def test_whole_normaliser_is_the_librarys():
    """A model with a character map, made from the public one's pieces: ids equal the library's with the same map."""
    m = proto.ModelProto()
    m.ParseFromString(pieces.load(MODEL))
    m.normalizer_spec.precompiled_charsmap = trie({"ﬁ".encode(): b"fi", b"\t": b" ", b"\n": b" ", "É".encode(): "é".encode()})
    m.normalizer_spec.remove_extra_whitespaces = True
    m.normalizer_spec.name = "own"
    library = sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    own = pieces.Encoder(m.SerializeToString())
    for text in ("  ﬁne\t\tÉtat  \n the end ", "", "   ", "a\tﬁ", "É"):
        assert np.frombuffer(own.encode(text, False)[0], "<u4").tolist() == library.encode(text)


def test_forgetting_changes_nothing(monkeypatch, sample):
    monkeypatch.setattr(pieces, "REMEMBERED", 20)
    e = pieces.Encoder(pieces.load(MODEL))
    for _, t, _ in sample[:20]:
        assert np.frombuffer(e.encode(t)[0], "<u4").tolist() == LIBRARY.encode(t, add_bos=True, add_eos=True)


def test_encode_table(docs, rows):
    long = "word " * 50_000
    df = docs((1, None), (2, ""), (3, "Hello\nworld"), (None, "x"), (3, "Hello\nworld"), (5, long)).withColumns({"ids": F.lit(1), "decoded": F.lit(2)})
    out = pieces.digests(pieces.encode(df, pieces.load(MODEL)))
    got = rows(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")

    def want(i, t):
        ids = LIBRARY.encode(t or "", add_bos=True, add_eos=True)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()

    assert got == [want(i, t) for i, t in ((None, "x"), (1, None), (2, ""), (3, "Hello\nworld"), (3, "Hello\nworld"), (5, long))]
    assert pieces.encode(df.limit(0), pieces.load(MODEL)).isEmpty()


# language


def held(i):
    return zlib.crc32(str(i).encode()) % 3 == 1


def test_language_of_held_out_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(d.withColumnRenamed("source", "score")).join(d.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == d.count() and all(r.held_out == held(r.doc_id) for r in got)
    tested = [r for r in got if r.held_out]
    assert sum(r.lang_pred == r.lang for r in tested) / len(tested) > 0.99
    assert all(0 <= r.score <= 1 for r in got) and sum(r.rejected for r in got) == 0


def test_language_edges(docs, sample):
    base = [(i, t, x) for i, t, x in sample]
    df = docs(*base, (1000, None), (1001, ""), (1002, "123 !!"), (1003, "von"), (None, "the and of"), (1004, sample[1][1] * 200), (1004, sample[1][1] * 200), (1005, "中文" * 50, None))
    got = langid.identify(df)
    out = {r.doc_id: r for r in got.collect()}
    assert got.count() == len(base) + 8
    assert [out[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and out[1000].score == 0
    assert out[1004].lang_pred == sample[1][2] and out[None].held_out is False
    assert out[1005].rejected and out[1005].lang_pred in {"de", "en", "es", "fr"}
    assert langid.identify(df.limit(0)).isEmpty()
    nothing = langid.identify(docs((1, "abc", None))).first()
    assert (nothing.lang_pred, nothing.rejected) == ("und", True)
    kept = langid.known(df, langid.train(df))
    assert kept.columns == df.columns and not {1000, 1001, 1002, 1005} & {r.doc_id for r in kept.collect()} and kept.count() == len(base) + 4


def test_language_learns_from_no_held_out_text(docs):
    i, j = next(i for i in range(100) if held(i)), next(i for i in range(100) if not held(i))
    model = langid.train(docs((i, "held out text", "xx"), (j, "some other text", "yy")))
    assert model.langs == ["yy"]


UNLEARNED = {
    "fi": "Vanha talo seisoo järven rannalla ja sen ikkunoista näkyy kauas metsän yli, mutta kukaan ei ole asunut siinä moneen vuoteen.",
    "hu": "A régi ház a tó partján áll, és ablakaiból messzire látni az erdő fölött, de évek óta nem lakik benne senki sem.",
    "tr": "Eski ev gölün kıyısında duruyor ve pencerelerinden ormanın üzerinden çok uzaklar görünüyor, ama yıllardır içinde kimse yaşamıyor.",
    "junk": "4111 1111 1111 1111 xk9q zzqx",
}


def test_one_labelled_junk_text_lets_no_unlearned_language_pass(docs, sample):
    junk = [(i, UNLEARNED["junk"], "fr") for i in (5000, 5001, 5002) if not held(i)][:1]
    model = langid.train(docs(*sample, *junk))
    got = {x: model.predict(t) for x, t in UNLEARNED.items()}
    assert all(got[x][2] for x in ("fi", "hu", "tr")), got
    assert not any(model.predict(t)[2] for _, t, _ in sample)
    assert not model.predict("the and of")[2]


def plain_ngrams(text):
    """Counts of the hashed n-grams, one by one."""
    letters = "".join(c if c.isalpha() else " " for c in text.lower())
    if not letters.strip():
        return None
    letters = f" {re.sub(' +', ' ', letters)} "
    out = Counter()
    u = lambda x: x & 0xFFFFFFFF
    one = [u(ord(c) * 0x9E3779B1) for c in letters]
    two = [u(one[i] * 0x85EBCA6B + ord(letters[i + 1]) * 0xC2B2AE35) for i in range(len(letters) - 1)]
    three = [u(two[i] * 0x27D4EB2F + ord(letters[i + 2]) * 0x165667B1) for i in range(len(letters) - 2)]
    for h in (*one, *two, *three):
        out[u((h ^ (h >> 15)) * 0x2C1B3C6D) >> 18] += 1
    return out


def plain_centroids(samples, k, idf):
    """Spherical k-means with dictionaries for vectors."""

    def unit(v):
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {a: x / size for a, x in v.items()}

    rows = [unit({a: (1 + math.log(n)) * idf.get(a, 0) for a, n in s.items()}) for s in samples]
    dot = lambda a, b: sum(x * b.get(i, 0) for i, x in a.items())
    found = [rows[int(i)] for i in np.linspace(0, len(rows) - 1, min(k, len(rows)))]
    for _ in range(10):
        near = [max(range(len(found)), key=lambda j: (dot(r, found[j]), -j)) for r in rows]
        for j in range(len(found)):
            mine = [r for r, x in zip(rows, near, strict=True) if x == j]
            if mine:
                found[j] = unit({a: sum(r.get(a, 0) for r in mine) for a in {a for r in mine for a in r}})
    return found


def test_op7_as_brute_force(spark, sample):
    """The query's languages and scores by a plain computation over all n-grams of every text."""
    texts = {i: (t, x, plain_ngrams(t)) for i, t, x in sample}
    langs = sorted({x for _, x, _ in texts.values() if x})
    order = lambda c: (np.array(sorted(c), "<i4").tobytes(), np.array([c[a] for a in sorted(c)], "<i8").tobytes())
    learned = {x: sorted((g for i, (_, y, g) in texts.items() if y == x and not held(i) and g), key=order) for x in langs}
    assert max(map(len, learned.values())) <= langid.SAMPLE
    n = sum(map(len, learned.values()))
    df = Counter(a for rows in learned.values() for g in rows for a in g)
    idf = {a: math.log((1 + n) / (1 + df.get(a, 0))) + 1 for a in range(langid.SIZE)}
    centroids = {x: plain_centroids(learned[x], langid.CENTROIDS, idf) for x in langs}
    got = {r.doc_id: r for r in queries.op7_language_id(spark, "/root/testdata/sf0.001").collect()}
    for i, (_, _, g) in texts.items():
        v = {a: (1 + math.log(k)) * idf[a] for a, k in g.items()}
        size = math.sqrt(sum(x * x for x in v.values()))
        best = {x: max(sum(w * c.get(a, 0) for a, w in v.items()) / size for c in cs) for x, cs in centroids.items()}
        lang = max(langs, key=lambda x: best[x])
        assert got[i].lang_pred == lang and got[i].score == pytest.approx(best[lang], abs=2e-4) and got[i].held_out == held(i)


def test_a_repeated_row_is_learned_from_once(docs, sample):
    """A third of the rows are one: the sample is that of the distinct ids, and no more comes to the driver."""
    some = [(i, t, x) for i, t, x in sample]
    one = next((i, t, x) for i, t, x in some if not held(i))
    a, b = langid.train(docs(*some)), langid.train(docs(*some, *[one] * 3000))
    assert np.array_equal(a.centroids, b.centroids) and a.floors == b.floors


# quality


def plain_features(text):
    words = re.findall(r"\w+|[^\w\s]+", text.lower())
    stems = Counter(w[:5] for w in words if len(w) > 5)
    names = {f"w {w}" for w in words} | {f"s {w}" for w in stems} | {f"r {w}" for w, n in stems.items() if n >= 3}
    loud = sum(text.count(c) for c in "AEINRST") * 2 > sum(text.lower().count(c) for c in "aeinrst")
    return {xxhash.xxh3_64_intdigest(w.encode("utf-8", "replace")) % (quality.SIZE - 2) for w in names} | {quality.SIZE - 1 if loud else quality.SIZE - 2}


def test_op4_as_brute_force(spark, sample):
    """The query's grades by a plain computation: each text's set of words, the likelihood of the ratings as it is written down, its
    slope by differences, and the same steps along it."""
    d = "/root/testdata/sf0.001"
    rated = {}
    for r in spark.read.parquet(f"{d}/labels.parquet").collect():
        q, t = rated.get(r.doc_id, (0, 0))
        rated[r.doc_id] = max(q, r.quality or 0), max(t, r.toxic or 0)
    grade = {i: 0 if t else 2 if q else 1 for i, (q, t) in rated.items()}
    sets = {i: plain_features(t) for i, t, _ in sample}
    rows = sorted((i for i in grade if i in sets), key=lambda i: (grade[i], np.array(sorted(sets[i]), "<i4").tobytes()))
    g = np.array([grade[i] for i in rows])
    df = Counter(a for i in rows for a in sets[i])
    least = min(quality.LEAST, max(1, len(rows) // 20))
    mean, spread = g.mean(), max(g.std(), 1e-9)
    off = lambda a: abs(sum(grade[i] - mean for i in rows if a in sets[i])) / math.sqrt(df[a]) / spread
    used = sorted(a for a in df if df[a] >= least and off(a) >= quality.SCREEN)
    x = np.array([[a in sets[i] for a in used] for i in rows], float).reshape(len(rows), len(used))

    def cost(v):
        """Of the weights, the first threshold and the logarithms of the steps between thresholds."""
        w, gap = v[: len(used)], v[len(used) :]
        b = np.concatenate([gap[:1], gap[0] + np.cumsum(np.exp(gap[1:]))])
        tail = np.concatenate([np.ones((len(rows), 1)), 1 / (1 + np.exp(b - (x @ w)[:, None])), np.zeros((len(rows), 1))], axis=1)
        return -np.mean(np.log(np.maximum(tail[np.arange(len(rows)), g] - tail[np.arange(len(rows)), g + 1], 1e-9))) + quality.RIDGE / 2 * w @ w

    share = [max(1e-3, min(1 - 1e-3, np.mean(g >= j))) for j in (1, 2)]
    start = [math.log((1 - s) / s) for s in share]
    v = np.concatenate([np.zeros(len(used)), [start[0], math.log(max(start[1] - start[0], 0.05))]])
    first, second = np.zeros_like(v), np.zeros_like(v)
    for t in range(1, quality.STEPS + 1):
        slope = np.array([(cost(v + e) - cost(v - e)) / 2e-5 for e in np.eye(len(v)) * 1e-5])
        first, second = 0.9 * first - 0.1 * slope, 0.999 * second + 0.001 * slope**2
        v = v + quality.RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    weight, b = dict(zip(used, v, strict=False)), [v[len(used)], v[len(used)] + math.exp(v[len(used) + 1])]
    got = {r.doc_id: r for r in queries.op4_quality(spark, d).collect()}
    for i, own in sets.items():
        s = sum(weight.get(a, 0) for a in own)
        usable, good = (1 / (1 + math.exp(t - s)) for t in b)
        assert got[i].p_usable == pytest.approx(usable, abs=5e-3) and got[i].p_good == pytest.approx(good, abs=5e-3)
        assert got[i].expected_grade == pytest.approx(usable + good, abs=1e-2)


def test_toxic_texts_are_told(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    train, test = labels.where("crc32(string(doc_id)) % 3 <> 1"), labels.where("crc32(string(doc_id)) % 3 = 1")
    got = quality.score(docs, quality.train(docs, train)).join(test, "doc_id").toPandas()
    good, clean = got[(got.quality == 1) & (got.toxic == 0)], got[got.toxic == 0]
    assert (~got[got.toxic == 1].kept).mean() > 0.75 and clean.kept.mean() > 0.99
    rank = got.p_good.rank()
    n, m = len(good), len(got) - len(good)
    assert (rank[good.index].sum() - n * (n + 1) / 2) / (n * m) > 0.93
    assert (got.p_good <= got.p_usable).all() and np.allclose(got.expected_grade, got.p_good + got.p_usable)


def test_ordinal_fit_orders_grades():
    r = np.random.default_rng(1)
    grades = r.integers(0, 3, 600)
    rows = [np.unique(np.array([1 + g, *r.integers(10, 400, 20)])) for g in grades]
    m = quality.fit(rows, grades)
    assert (np.diff(m.thresholds) > 0).all()
    assert m.weights[1] < m.weights[2] < m.weights[3]
    assert np.mean([np.sum(m.tails(x) >= 0.5) == g for x, g in zip(rows, grades, strict=True)]) > 0.95


def test_quality_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 1), (None, 1, 0), (99, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    df = docs((1, "fine text"), (2, "bad text"), (3, None), (4, ""), (None, "x"), (1, "fine text"), (5, "w " * 100_000)).withColumn("kept", F.lit("x"))
    assert quality.score(df, quality.train(df, labels)).count() == 7
    blank = quality.score(df, quality.train(df, labels.limit(0))).where("doc_id = 3").first()
    assert 0 < blank.p_good < blank.p_usable < 1
    assert quality.score(df.limit(0), quality.train(df.limit(0), labels)).isEmpty()


# language models


def test_losses_as_brute_force(spark, docs, sample):
    data = sample[:60]
    labels = spark.createDataFrame([(i, int(i % 2 == 0), int(i % 8 == 0)) for i, _, _ in data] + [(data[0][0], 1, 1)], "doc_id long, quality int, toxic int")
    df = docs(*data, (900, None), (901, "!!"), (None, "the of")).withColumn("n_tokens", F.lit(0))
    got = {r.doc_id: r for r in lm.score(df, lm.count(df, labels)).collect()}
    known = {}
    every = [lm.tokens(t, known) for _, t, _ in data] + [lm.tokens("the of", known)]
    target = [x for (i, _, _), x in zip(data, every, strict=False) if i % 2 == 0 and i % 8 != 0]

    def losses(model, words, pairs):
        n, both = {}, {}
        for w, p in model:
            for k, x in enumerate(w.tolist()):
                n[x] = n.get(x, 0) + 1
                if k:
                    both[p[k]] = both.get(p[k], 0) + 1
        size = sum(n.values())
        out = 0
        for k, x in enumerate(words.tolist()):
            p = (n.get(x, 0) + lm.FLOOR) / (size + lm.FLOOR * lm.VOCABULARY)
            out -= np.log(((both.get(pairs[k], 0) + lm.MASS * p) / (n.get(int(words[k - 1]), 0) + lm.MASS)) if k else p)
        return out / len(words)

    for (i, _, _), (w, p) in list(zip(data, every, strict=False))[:12]:
        assert got[i].target_loss == pytest.approx(losses(target, w, p), abs=1e-3)
        assert got[i].background_loss == pytest.approx(losses(every, w, p), abs=1e-3)
        assert got[i].difference == pytest.approx(got[i].target_loss - got[i].background_loss)
    assert got[900].n_tokens == 0 and got[900].target_loss is None and got[901].difference is None and got[None].n_tokens == 2
    assert lm.score(df.limit(0), lm.count(df.limit(0), labels)).isEmpty()


def plain_words(text):
    return [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower()) if w]


def test_losses_by_the_words_themselves(spark, docs, sample):
    """The models over words as they are written, without a hash, and each history's probabilities sum to 1."""
    data = sample[:80]
    labels = spark.createDataFrame([(i, int(i % 3 == 0), 0) for i, _, _ in data], "doc_id long, quality int, toxic int")
    df = docs(*data)
    got = {r.doc_id: r for r in lm.score(df, lm.count(df, labels)).collect()}
    texts = {i: plain_words(t) for i, t, _ in data}
    vocabulary = max(lm.VOCABULARY, len({w for t in texts.values() for w in t}))
    for column, chosen in (("target_loss", [i for i in texts if i % 3 == 0]), ("background_loss", list(texts))):
        one, two, ends = Counter(), Counter(), Counter()
        for i in chosen:
            one.update(texts[i])
            two.update(zip(texts[i], texts[i][1:], strict=False))
            ends.update(texts[i][-1:])
        size = sum(one.values())
        p = lambda w, one=one, size=size: (one[w] + lm.FLOOR) / (size + lm.FLOOR * vocabulary)
        after = lambda h, w, one=one, two=two, p=p: (two[h, w] + lm.MASS * p(w)) / (one[h] + lm.MASS)
        for i, t in texts.items():
            if t:
                loss = -(math.log(p(t[0])) + sum(math.log(after(h, w)) for h, w in zip(t, t[1:], strict=False))) / len(t)
                assert got[i][column] == pytest.approx(loss, abs=1e-9) and got[i].n_tokens == len(t)
        unseen = (vocabulary - len(one)) * lm.FLOOR / (size + lm.FLOOR * vocabulary)
        for h in list(one)[:20]:
            total = sum(after(h, w) for w in one) + lm.MASS * unseen / (one[h] + lm.MASS) + ends[h] / (one[h] + lm.MASS)
            assert total == pytest.approx(1, abs=1e-9)


def test_counts_grow_with_the_words(spark, docs):
    """Every word and pair has its own count: more pairs than 2^20 classes hold, and a text's probabilities are those of its own words."""
    r = np.random.default_rng(0)
    data = [(i, " ".join(f"w{x}" for x in r.integers(0, 300_000, 4_000))) for i in range(400)] + [(400, "alpha beta " * 3)]
    labels = spark.createDataFrame([(400, 1, 0)], "doc_id long, quality int, toxic int")
    df = docs(*data)
    model = lm.count(df, labels)
    every = [x for _, t in data for x in t.split()]
    assert (model.words, model.sizes) == (len(set(every)), (6, len(every)))
    got = lm.score(df, model).where("doc_id = 400").first()
    for loss, size in ((got.target_loss, 6), (got.background_loss, len(every))):
        p = 3.5 / (size + lm.FLOOR * model.words)
        want = -(np.log(p) + 3 * np.log((3 + lm.MASS * p) / (3 + lm.MASS)) + 2 * np.log((2 + lm.MASS * p) / (3 + lm.MASS))) / 6
        assert loss == pytest.approx(want, abs=1e-9)


def test_losses_do_not_depend_on_blocks(spark, docs, sample, rows, monkeypatch):
    labels = spark.createDataFrame([(i, int(i % 2 == 0), 0) for i, _, _ in sample], "doc_id long, quality int, toxic int")
    df = docs(*sample, (None, "the of"), (None, None), (900, "same text"), (900, "same text"))
    want = rows(lm.score(df, lm.count(df, labels)))
    monkeypatch.setattr(lm, "BLOCK_BYTES", 2_000)
    monkeypatch.setattr(lm, "RANGES", 4)
    model = lm.count(df, labels)
    got = rows(lm.score(df, model))
    assert model.blocks > 8 and len(got) == len(want)
    assert all(a[:2] == b[:2] and a[2:] == (pytest.approx(b[2:]) if b[1] else b[2:]) for a, b in zip(got, want, strict=True))


def test_counting_leaves_no_texts_on_disk(spark, docs):
    """The texts and keys that counting deals out are gone before scoring deals the texts out again, whenever garbage is collected."""
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {x for x in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    r = np.random.default_rng(1)
    df = docs(*((i, " ".join(f"w{x}" for x in r.integers(0, 300_000, 4_000))) for i in range(100)))
    labels = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    before, setting = shuffled(), spark.conf.get(common.SHUFFLES_GO, None)
    model = lm.count(df, labels)
    for _ in range(50):  # they go beside
        left = sum(Path(x).stat().st_size for x in shuffled() - before if Path(x).exists())
        if left < 100_000:
            break
        time.sleep(0.1)
    assert left < 100_000
    assert spark.conf.get(common.SHUFFLES_GO, None) == setting
    assert lm.score(df, model).count() == 100
