import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import common, minhash


def brute(rows, width, percent):
    """{doc_id: (n_shingles, component)} by comparing all sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = frozenset(tuple(w[j : j + width]) for j in range(max(1, len(w) - width + 1))) if w else frozenset()
    top = {i: i for i in sets}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = sorted((root(a), root(b)))
                    top[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(r, words, n):
    words = list(words)
    for _ in range(n):
        words[r.randrange(len(words))] = f"w{r.randrange(10**6)}"
    return words


def groups(seed=1):
    """Chains and clusters of near copies of many degrees, among other texts."""
    r = random.Random(seed)
    rows, at = [], 0
    for g in range(12):
        base = [f"v{r.randrange(400)}" for _ in range(r.choice([20, 60, 150]))]
        words = base
        for k in range(r.choice([2, 5, 30])):
            words = edited(r, words if g % 2 else base, 1 + r.randrange(1 + len(base) // 25))
            rows.append((at, " ".join(words).upper() if k % 3 == 0 else "\n".join(words)))
            at += 1
            if k % 4 == 0:
                rows.append((at, rows[-1][1]))
                at += 1
    rows += [(at + i, " ".join(f"u{r.randrange(300)}" for _ in range(r.randrange(1, 40)))) for i in range(60)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_same_as_comparing_all(docs, width, percent):
    rows = groups(percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(*rows), width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_small_blocks_and_slices_lose_nothing(docs, monkeypatch):
    """Every split of hot groups is taken: blocks of two members, slices of two partners, ids joined by a shuffle."""
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "SLICE", 2)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 0)
    rows = groups(7)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(*rows), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_strays_beside_a_large_component_cost_as_much_as_it_is_long(spark, monkeypatch):
    """Members of the largest component come once for each block of the others, not once for each block of their own."""
    monkeypatch.setattr(minhash, "BLOCK", 100)
    data = [(i, 0, 7, 5) for i in range(5000)] + [(9000, 9000, 7, 5), (9001, 9001, 7, 5)] + [(9100, 9100, 8, 10**7), (9101, 9101, 8, 1)]
    dealt = minhash._dealt(spark.createDataFrame(data, "node long, component long, grp long, n_shingles long")).select("node", "to.*").collect()
    large = [r for r in dealt if r.node < 5000]
    assert len(large) == 5000 and len([r for r in dealt if r.node in (9000, 9001)]) == 2 * 51
    met = {(r.bi, r.bj) for r in dealt if r.node == 9000}
    assert all((r.bi, r.bj) in met for r in large)
    assert {(r.grp, r.bi, r.bj) for r in dealt if r.node == 9100} & {(r.grp, r.bi, r.bj) for r in dealt if r.node == 9101}


def test_real_texts(docs, sample):
    rows = [(i, t) for i, t, _ in sample]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs(*rows), 3, 85).collect()}
    assert got == brute(rows, 3, 85)


def test_edges(docs, rows):
    long = " ".join(f"l{i}" for i in range(30_000))
    df = docs((1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, long), (7, long + " end"), (None, "one two"), (9, "x"), (9, "x"), (10, "É a b c"), (11, "é a b c"))
    df = df.withColumns({"node": F.lit(1), "component": F.lit("c"), "sig": F.lit(2)})
    got = rows(minhash.near_duplicates(df, 3, 85))
    assert got == [(None, 1, None, True), (1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 29998, 6, True), (7, 29999, 6, False), (9, 1, 9, True), (9, 1, 9, True), (10, 2, 10, True), (11, 2, 11, True)]
    kept = minhash.representatives(df, 3, 85)
    assert kept.columns == df.columns
    assert rows(kept, "doc_id") == [(None,), (1,), (2,), (3,), (4,), (6,), (9,), (10,), (11,)]


def test_empty_table(docs):
    assert minhash.near_duplicates(docs((1, "x")).limit(0)).isEmpty()


def test_bands_miss_next_to_nothing():
    for t in (0.8, 0.85, 0.9):
        b, r = minhash.bands_for(t)
        assert b * r <= minhash.HASHES and (1 - t**r) ** b <= minhash.MISS


def test_signature_estimates_similarity():
    r = np.random.default_rng(1)
    for share in (0.3, 0.8):
        a = np.unique(r.integers(0, 2**63, 2000).astype(np.uint64))
        n = int(len(a) * share * 2 / (1 + share))
        b = np.unique(np.concatenate([a[:n], r.integers(0, 2**63, len(a) - n).astype(np.uint64)]))
        j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        same = np.mean(minhash.signature(a, 1024) == minhash.signature(b, 1024))
        assert abs(same - j) < 0.06


def test_components(spark, rows):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 300)] + [(7, 7), (500, 501), (501, 500)]
    got = {a: b for a, b in rows(common.components(spark.createDataFrame(chain, "a long, b long")))}
    assert {got[i] for i in range(0, 41)} == {0} and {got[i] for i in range(100, 300)} == {100} and got[501] == 500
    assert common.components(spark.createDataFrame([], "a long, b long")).isEmpty()
