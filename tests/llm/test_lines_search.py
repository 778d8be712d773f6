import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidelog.llm import lines, queries, search

COMMON = "\n".join(f"line {i} of the common passage" for i in range(24))


def words(line):
    return line.count(" ") + 1 if line else 0


def brute(rows, whole=None):
    """{doc_id: (text, n_removed)}: every pair of lines and every long line against all earlier ones."""
    first, out = {}, {}
    units = lambda ls: [(k, n, (n, *ls[k : k + n])) for k in range(len(ls)) for n in (1, 2) if (words(ls[k]) >= lines.PASSAGE if n == 1 else k + 1 < len(ls))]
    for i, t in sorted(rows):
        for k, _, body in units(t.split("\n")) if t is not None else ():
            first.setdefault(body, (i, k))
    for i, t in sorted(rows):
        if t is None:
            out[i] = (None, 0)
            continue
        ls = t.split("\n")
        covered = sorted({x for k, n, body in units(ls) if first[body] != (i, k) for x in range(k, k + n)})
        runs = []
        for k in covered:
            if runs and runs[-1][-1] == k - 1:
                runs[-1].append(k)
            else:
                runs.append([k])
        runs = [r for r in runs if sum(words(ls[k]) for k in r) >= lines.PASSAGE]
        if whole is not None and runs and sum(words(ls[k]) for r in runs for k in r) >= whole * sum(map(words, ls)):
            runs = []
        gone = {k for r in runs for k in r}
        out[i] = ("\n".join(x for k, x in enumerate(ls) if k not in gone), len(runs))
    return out


def test_line_dedup_as_brute_force(docs, sample):
    rows = [(i, t) for i, t, _ in sample] + [(1000, "x\n" + COMMON + "\ny"), (1001, COMMON), (1002, "a\nb\nc\n" + COMMON), (1003, ""), (1004, None), (1005, COMMON + "\n" + COMMON), (1006, "\n\n\n"), (1007, "\n\n\n")]
    got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup(docs(*rows)).collect()}
    assert got == brute(rows)
    assert got[1001][1] > 0 and got[1002][1] > 0  # shifted copies are found


def test_line_dedup_edges(docs, rows):
    df = docs((None, COMMON), (1, COMMON), (1, COMMON), (2, "one line"), (3, "one line")).withColumns({"n_removed": F.lit("x"), "key": F.lit(1), "doc": F.lit(2), "gone": F.lit(3), "row": F.lit(4), "asked": F.lit(5), "new": F.lit(6), "__doc": F.lit(7), "d.k": F.lit(8)})
    got = lines.dedup(df)
    assert got.columns == [c for c in df.columns if c != "n_removed"] + ["n_removed"]
    assert {tuple(r)[-7:-1] for r in got.collect()} == {(3, 4, 5, 6, 7, 8)}
    out = rows(got, "doc_id", "n_removed")
    assert [x for x in out if x[0] == 1] == [(1, 0), (1, 0)] and out[0][0] is None and out[0][1] > 0
    assert rows(got.where("doc_id > 1"), "text") == [("one line",), ("one line",)]
    assert lines.dedup(df.limit(0)).isEmpty()
    huge = "\n".join(f"l{i % 50}" for i in range(20_000))
    long = lines.dedup(docs((1, huge)))
    assert long.first().text == brute([(1, huge)])[1][0]


def test_line_dedup_on_the_table(spark):
    """A larger table against brute force, and every passage that is planted between other lines goes, whatever its lines."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    data = [(r.doc_id, r.text) for r in d.collect()]
    passages = [[" ".join(f"p{n}x{j}y{k}" for k in range(-(-60 // n))) for j in range(n)] for n in (1, 2, 3, 5, 20)]
    data += [(10_000 + 10 * at + k, "\n".join([f"before {at} {k}", *p, f"after {k} {at}"])) for k, p in enumerate(passages) for at in range(3)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(7)
    for whole in (None, lines.WHOLE):
        got = {r.doc_id: (r.text, r.n_removed) for r in lines.dedup(df, whole).collect()}
        assert got == brute(data, whole)
    got = {r.doc_id: r.text for r in lines.dedup(df).collect()}
    assert all(got[10_000 + 10 * at + k] == f"before {at} {k}\nafter {k} {at}" for k in range(len(passages)) for at in (1, 2))
    assert got[10_000] == data[-15][1]


def test_short_repeats_stay(docs, rows):
    short = "a line that many have\nand the next line"
    df = docs((1, short), (2, f"x\n{short}\ny"), (3, f"{short}\n\n\n\nend"), (4, "}\n}\n}\n"), (5, "}\n}\n}\n"))
    assert rows(lines.dedup(df), "text") == rows(df, "text") and {r.n_removed for r in lines.dedup(df).collect()} == {0}


def test_parts_of_a_passage_go(docs):
    """A copy of the middle of a passage, and one that runs over its end."""
    ls = COMMON.split("\n")
    got = {r.doc_id: r.text for r in lines.dedup(docs((1, COMMON), (2, "\n".join(["q", *ls[5:16], "r"])), (3, "\n".join([*ls[12:], "tail of three"])))).collect()}
    assert got == {1: COMMON, 2: "q\nr", 3: "tail of three"}


def test_line_dedup_has_no_python(docs):
    plan = lines.dedup(docs((1, "a\nb"), (2, "a\nb")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def brute_search(rows, k):
    toks = {i: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").lower()) if w] for i, t in rows}
    df = Counter(w for ts in toks.values() for w in set(ts))
    n, mean = len(toks), sum(map(len, toks.values())) / len(toks)
    out = []
    for q in [i for i in toks if i % 100 == 0]:
        terms = set(toks[q])
        scored = []
        for i, ts in toks.items():
            tf = Counter(ts)
            s = sum(math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ts) / mean)) for w in terms if tf[w])
            if terms & set(ts):
                scored.append((-round(s, 6), i))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def test_search_as_brute_force(docs, sample, rows, monkeypatch):
    data = [(i, t) for i, t, _ in sample] + [(300, None), (400, ""), (500, sample[0][1]), (501, sample[0][1])]
    df = docs(*data)
    want = brute_search(data, 10)
    close = lambda got: [(a, b, c, pytest.approx(d, abs=2e-6)) for a, b, c, d in got]
    assert close(rows(search.search(df, df.where("doc_id % 100 = 0")))) == want
    monkeypatch.setattr(search, "BLOCK_TERMS", 50)  # a block a query
    assert close(rows(search.search(df, df.where("doc_id % 100 = 0")))) == want


def test_pruning_skips_blocks_and_is_exact():
    import numpy as np

    r = np.random.default_rng(3)
    slots = [np.unique(np.minimum(r.zipf(1.3, 40), 500)) - 1 for _ in range(5000)]
    counts = [r.integers(1, 5, len(s)) for s in slots]
    asked = [slots[0], slots[17], np.array([400, 401, 402]), np.array([499])] + slots[100:140]
    for ids in (list(range(5000)), list(range(5000, 0, -1))):
        q = search.Queries([(i, np.asarray(t, np.uint64)) for i, t in enumerate(asked)])
        q.idf = np.log(1 + 5000 / (1 + np.bincount(np.concatenate(slots), minlength=500)))[q.vocabulary.astype(int)]
        # slots are words here; the shard wants places in the queries' vocabulary
        place = {int(w): j for j, w in enumerate(q.vocabulary)}
        own = [(np.array([place[t] for t in s if t in place], int), np.array([n for t, n in zip(s, c, strict=True) if t in place], int)) for s, c in zip(slots, counts, strict=True)]
        shard = search.Shard(ids, [int(c.sum()) for c in counts], [a for a, _ in own], [b for _, b in own], 80.0)
        got = sorted((int(a), -round(float(s), 6), int(d)) for a, d, s in zip(*shard.top(q, 5), strict=True))
        want = []
        for i, t in enumerate(asked):
            terms, every = {place[int(x)] for x in t}, []
            for j, (s, c) in enumerate(own):
                x = sum(q.idf[w] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * counts[j].sum() / 80.0)) for w, n in zip(s, c, strict=True) if w in terms)
                if x:
                    every.append((-round(x, 6), ids[j]))
            want += [(i, *e) for e in sorted(every)[:5]]
        assert got == sorted(want)


def test_index_holds_every_word_and_small_shards_lose_nothing(docs, sample, rows, monkeypatch):
    """Shards of few rows or postings, of which a task takes several and carries the k-th score on."""
    import numpy as np

    data = [(i, t) for i, t, _ in sample[:120]] + [(300, sample[3][1]), (None, "x")]
    df = docs(*data, parts=2)
    want = rows(search.search(df, df.where("doc_id % 100 = 0")))
    monkeypatch.setattr(search, "SHARD_ROWS", 14)
    monkeypatch.setattr(search, "POSTINGS", 1200)
    monkeypatch.setattr(search, "PARTS", 2)
    monkeypatch.setattr(search, "PAIRS", 50)
    assert rows(search.search(df, df.where("doc_id % 100 = 0"))) == want
    shards = search.build(df.where("doc_id is not null")).collect()
    assert len(shards) > 17 and max(r.rows for r in shards) <= 7
    n = {int(i): int(x) for r in shards for i, x in zip(np.frombuffer(bytes(r.ids), "<i8"), np.frombuffer(bytes(r.lengths), "<i8"), strict=True)}
    assert n == {i: len([w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", t.lower()) if w]) for i, t in data if i is not None}


def test_search_edges(docs):
    empty = docs((1, "x")).limit(0)
    assert search.search(empty, empty).isEmpty()
    assert search.search(docs((1, "x")), empty).isEmpty()
    got = search.search(docs((1, "a b"), (1, "a b"), (None, "a"), (3, "c")).withColumn("score", F.lit(1)), docs((100, "A!"), (100, "A!"), (200, None)))
    assert [(r.query_id, r.rank, r.doc_id) for r in got.orderBy("rank").collect()] == [(100, 1, 1), (100, 2, 1)]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_against_sql(spark, name):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    want = con.sql(queries.ORACLE_SQL[name])
    columns = sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    got = queries.QUERIES[name](spark, d)
    assert sorted(got.columns) == columns
    text = lambda r: tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r)
    assert sorted(text(r) for r in got.select(*columns).collect()) == sorted(text([r[i] for i in at]) for r in want.fetchall())
