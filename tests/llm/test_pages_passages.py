import base64
import gzip
import hashlib
import random
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidelog.llm import decontam, warc, wrapper

PAGES = "page_id long, url string, html string"


def texts(html):
    return [t for _, t in wrapper.blocks(html)]


PAGE = """<!DOCTYPE html><html class="no-js has-sidebar"><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head>
<body><header class="site-header"><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="adBanner">Buy</div><div class="layout with-sidebar"><main><article><h1>Caf&eacute; &amp;   <i>tea</i></h1><!-- x --><p>One <b>two
three&nbsp;four<p>Five<br>six<ul><li>seven<li>eight</ul><table><tr><td>c1<td>c2</table><form>f<input></form><figure><figcaption>cap</figcaption></figure>
<div class="share-buttons">Share</div><blockquote>quote &lt;b&gt; &#8212; end</blockquote><pre>a
  b</pre></article><section id="comments"><article class="comment"><p>first!</p></article></section></main><div class="sidebar">side</div></div>
<aside>aside</aside><footer>foot</footer></body></html>"""


def test_article_without_the_rest():
    assert texts(PAGE) == ["Café & tea", "One two three four", "Five six", "seven", "eight", "c1", "c2", "cap", "quote <b> — end", "a b"]


@pytest.mark.parametrize("html", [None, "", "   ", "<html>", "</p></div>", "<!-- ", "<script>x", "<p", "<a href='>'>", "<nav>x</nav>"])
def test_odd_html_has_no_text(html):
    assert texts(html) == []


def test_page_without_named_regions():
    page = """<body><div id="topnav"><a href=/>Home</a></div><ul><li><a href=/a>Link one</a><li><a href=/b>Link two</a></ul><div class="post"><h2><a href=/x>Linked title</a></h2>
    <p>Text &amp;lt; with <a href=/y>a link</a> in it.</p></div><div id="secondary">x</div><div class="userComments"><p>hi</p></div><div hidden>h</div><p style="display: none">n</p></body>"""
    assert texts(page) == ["Linked title", "Text &lt; with a link in it."]


def test_unclosed_and_deep():
    assert texts("<p>a<p>b<div>c") == ["a", "b", "c"]
    assert texts("<p>1 < 2") == ["1 < 2"] and texts("<p>cut <a hre") == ["cut"]
    assert texts('<p title="open>one</p><p>two</p>')[-1] == "two"
    assert texts("<div>" * 5000 + "deep" + "</div>" * 5000) == ["deep"]
    assert texts("plain text\n only") == ["plain text only"]
    assert texts("<article>x" + "<b>y" * 3000) == ["x" + "y" * 3000]


def test_pages_of_the_table(spark):
    """Every page of the table has its article, as cut out by hand."""
    from html import unescape

    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in wrapper.extract(d).collect()}
    for r in d.collect():
        body = r.html[r.html.index("<article>") :].split("</article>")[0]
        parts = [" ".join(unescape(re.sub(r"<[a-zA-Z/!][^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1|article)[^>]*>", body)]
        assert got[r.page_id].text == "\n\n".join(x for x in parts if x)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def shell(i, more=""):
    return f"<html><body><div class=x><div class=t>Welcome to our site</div><h3>Story {i} title</h3><p>Body {i} with words {i * 7}</p>{more}<div>All rights reserved here</div></div></body></html>"


def test_constant_nodes_are_template(spark):
    rows = [(i, f"http://h.example/{i}", shell(i, "<p>extra</p>" if i % 3 == 0 else "")) for i in range(12)] + [(50, "http://other.example/", shell(50)), (51, None, shell(51))]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert got[1] == "Story 1 title\n\nBody 1 with words 7"
    assert got[3] == "Story 3 title\n\nBody 3 with words 21\n\nextra"
    assert got[50].startswith("Welcome to our site") and got[51].startswith("Welcome to our site")  # nothing to align with


def test_copies_of_a_page_are_no_template(spark):
    rows = [(i, "http://h.example/", shell(1)) for i in range(20)]
    got = {r.text for r in wrapper.extract(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(got) == 1 and "Story 1 title" in got.pop()


def test_templates_by_a_shuffle(spark, monkeypatch):
    monkeypatch.setattr(wrapper, "BROADCAST_BYTES", -1)
    rows = [(i, f"http://h.example/{i}", shell(i)) for i in range(8)]
    assert {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(rows, PAGES)).collect()}[1] == "Story 1 title\n\nBody 1 with words 7"


def test_tree_matching():
    leaf = lambda label, text="": wrapper.Tree(label, text, [])
    a = wrapper.Tree("r", "", [leaf("p", "1"), leaf("d", "x"), leaf("p", "2")])
    b = wrapper.Tree("r", "", [leaf("p", "9"), leaf("p", "2")])
    score, pairs = wrapper.match(a, b)
    assert score == 4 and [(x.text, y.text) for x, y in pairs] == [("2", "2"), ("1", "9")]
    assert wrapper.match(a, wrapper.Tree("q", "", [])) == (0, [])


def lexicon(r, n):
    return " ".join("".join(r.choice("abcdefghilmnorstu") for _ in range(r.randrange(2, 9))) for _ in range(n)).capitalize() + "."


def site(seed, i):
    """(html, text) of page i of a site that names nothing: tags are div and p, every class is noise, menus and adverts differ by page."""
    r = random.Random(seed * 1000 + i)
    noise = lambda: f"c{r.randrange(10**9)}"
    menu = "".join(f"<div class={noise()}><a href=/{r.random()}>{lexicon(r, 2)}</a></div>" for _ in range(r.randrange(3, 7)))
    body = [lexicon(r, r.randrange(30, 60)) for _ in range(r.randrange(4, 9))]
    inner = "".join(f"<p>{x}</p>" + (f"<div class={noise()}>Share this story</div>" if k == 1 else "") for k, x in enumerate(body))
    advert = f"<div class={noise()}><div>{lexicon(r, 5)}</div></div>" if i % 3 else ""
    title = lexicon(r, 5)
    html = f"<body><div class={noise()}><div>The Daily {seed}</div><div>{menu}</div></div>{advert}<div class={noise()}><h1>{title}</h1><div class={noise()}>{inner}</div></div><div class={noise()}><p>All rights reserved</p><p>{lexicon(r, 4)}</p></div></body>"
    return html, "\n\n".join([title, *body])


def test_pages_that_name_nothing(spark):
    """Constant nodes go wherever they stand, and the slot with the varying text is found without any tag or name."""
    want, data = {}, []
    for seed in range(3):
        for i in range(12):
            html, want[seed * 100 + i] = site(seed, i)
            data.append((seed * 100 + i, f"http://h{seed}.example/{i}", html))
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(data, PAGES).repartition(5)).collect()}
    assert got == want


def test_pages_of_the_table_without_names(spark):
    """The table's pages with every class noise give the same; with every region a div, alignment alone finds nearly all articles."""
    d = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = {r.page_id: r.text for r in wrapper.extract(d).collect()}
    noisy = d.withColumn("html", F.regexp_replace("html", 'class="[^"]*"', 'class="q7 zx"'))
    assert {r.page_id: r.text for r in wrapper.extract(noisy).collect()} == want
    bare = noisy.withColumn("html", F.regexp_replace("html", "<(/?)(article|nav|footer|aside|header)>", "<$1div>"))
    hosts = [r.host for r in wrapper.skeletons(bare.withColumn("host", wrapper.host_of(F.col("url")))).select("host").collect()]
    got = [(r.page_id, r.text) for r in wrapper.extract(bare).where(wrapper.host_of(F.col("url")).isin(hosts)).collect()]
    assert len(got) > 50 and sum(t == want[i] for i, t in got) > 0.9 * len(got)


def test_a_template_text_elsewhere_stays(spark):
    """A text goes at the aligned node only, not wherever it recurs."""
    page = lambda i: f"<article><p>Note</p><h2>T {i}</h2><p>text {i} {i * 3}</p>{'<p>Note</p>' if i == 4 else ''}</article>"
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame([(i, f"http://h/{i}", page(i)) for i in range(12)], PAGES)).collect()}
    assert got[3] == "T 3\n\ntext 3 9" and got[4].count("Note") == 1


def test_all_pages_vote(spark):
    """A notice on four of five pages of a host goes, in whatever partitions they are; copies of one page are one vote."""
    page = lambda i: f"<article><p>par {i}</p>{'<p>Read our other stories</p>' if i % 5 else ''}<p>end {i}</p></article>"
    data = [(i, f"http://h/{i}", page(i)) for i in range(200)] + [(1000 + i, "http://h/x", page(5)) for i in range(300)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(data, PAGES).repartition(20)).collect()}
    assert not any("other stories" in t for t in got.values()) and got[7] == "par 7\n\nend 7" and len(got) == 500


def test_all_pages_make_the_skeleton(spark):
    """A notice within a block that one page of 25 has goes too, and its neighbours stay: of the pages that have the block all have it."""
    def page(h, i):
        more = f"<section><h3>head {h} {i}</h3><p>Read our other stories</p><p>more {h} {i}</p></section>" if i % 25 == 7 else ""
        return f"<article><p>par {h} {i}</p>{more}<p>end {h} {i}</p></article>"

    data = [(1000 * h + i, f"http://h{h}/{i}", page(h, i)) for h in range(4) for i in range(200)]
    got = {r.page_id: r.text for r in wrapper.extract(spark.createDataFrame(data, PAGES).repartition(7)).collect()}
    want = lambda h, i: f"par {h} {i}" + (f"\n\nhead {h} {i}\n\nmore {h} {i}" if i % 25 == 7 else "") + f"\n\nend {h} {i}"
    assert got == {1000 * h + i: want(h, i) for h in range(4) for i in range(200)}


def test_skeletons_hold_every_block_in_any_partitions(spark):
    """Every page's tree is within its host's skeleton, which doesn't depend on how rows are dealt out or repeated."""
    def page(i):
        r = random.Random(i)
        some = lambda depth: "".join(f"<{t}>{some(depth - 1) or lexicon(r, 2)}</{t}>" for t in r.choices(["div", "p", "h2", "section"], k=r.randrange(4)) if depth)
        return f"<article>{some(3)}<p>{i}</p></article>"

    pages = [page(i) for i in range(300)]
    forms = []
    for rows, parts in ((pages, 1), (pages[::-1] + pages[:50], 5)):
        df = spark.createDataFrame([("h", p) for p in rows], "host string, html string").repartition(parts)
        forms += [bytes(r.form) for r in wrapper.skeletons(df).collect()]
    assert len(forms) == 2 and forms[0] == forms[1]
    m = wrapper.Matcher()
    top = wrapper.unpacked(forms[0])
    m.measure(top)
    for p in pages:
        tree = wrapper.tree_of(p)
        m.measure(tree, whole=False)
        for k, x in enumerate(tree.order()):
            x.whole = -k - 2  # so that no equal texts count
        assert len(m.align(top, tree)) == tree.size


@pytest.mark.parametrize("name", "share-price nav-history social-history related notice rail banner reply promo subscribe".split())
def test_a_subject_is_no_name_of_boilerplate(name):
    assert texts(f"<article><h1>T</h1><p>one</p><section class={name}><p>x</p></section><p>two</p></article>") == ["T", "one", "x", "two"]


def test_regions():
    assert texts("<main><p>a</main><div>x</div><main><p>b</main>") == ["a", "b"]
    assert texts("<div><h1>A</h1><h1>B</h1></div><article><p>c</article>") == ["A", "B", "c"]
    assert texts("<body><p>See <a href=/x>the long report on this</a>.</p></body>") == ["See the long report on this."]
    assert texts("<article><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> it is</article>") == ["So x=1 it is"]


def test_deep_and_wide_pages(spark):
    deep = lambda i: f"<h1>Head {i}</h1>{'<div>' * 1500}<article>{'<section>' * 1500}deep {i}</article>"
    wide = lambda i: "<body><h1>Wide</h1><article>" + "".join(f"<p>par {i} {j}</p>" for j in range(1900 + i)) + "</article></body>"
    data = [(i, "http://deep/", deep(i)) for i in range(6)] + [(100 + i, "http://wide/", wide(i)) for i in range(6)] + [(200, "http://deep/", "<div>" * 5000 + "x")]
    got = {r.page_id: r for r in wrapper.extract(spark.createDataFrame(data, PAGES)).collect()}
    assert got[3].text == "Head 3\n\ndeep 3" and got[103].text.count("\n\n") == 1902 and got[200].text == "x"


@pytest.mark.parametrize("cells", [1 << 23, 8])
def test_tree_matching_is_best(cells, monkeypatch):
    """The score against the plain recursion over all pairs, also where the table is halved."""
    monkeypatch.setattr(wrapper.Matcher, "CELLS", cells)

    def plain(a, b):
        if a.label != b.label:
            return 0
        best = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids):
            for j, y in enumerate(b.kids):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + plain(x, y))
        return 1 + best[-1][-1]

    def tree(r, depth):
        return wrapper.Tree(r.choice("pd") if depth < 3 else "r", "", [tree(r, depth - 1) for _ in range(r.randrange(0, 6))] if depth else [])

    for seed in range(30):
        r = random.Random(seed)
        a, b, m = tree(r, 3), tree(r, 3), wrapper.Matcher()
        m.measure(a, whole=False)
        m.measure(b, whole=False)
        for x in [*a.order(), *b.order()]:
            x.whole = id(x) % 2**62
        assert m.weigh(a.shape, b.shape) == plain(a, b) == len(m.align(a, b))


@pytest.mark.parametrize("cells", [1 << 23, 8])
def test_small_and_large_tables_agree(cells, monkeypatch):
    """Tables filled with and without NumPy give the same pairs, and one that is halved gives pairs of the same weight."""
    def leaves(r, n):
        return [wrapper.Tree(r.choice("pdu"), r.choice("abcdefgh"), [wrapper.Tree("s", "", []) for _ in range(r.randrange(3))]) for _ in range(n)]

    for seed in range(60):
        r = random.Random(seed)
        a, b = (wrapper.Tree("r", "", leaves(r, r.randrange(1, 16))) for _ in range(2))
        found = []
        for few, most in ((500, 1 << 23), (0, cells)):
            monkeypatch.setattr(wrapper.Matcher, "FEW", few)
            monkeypatch.setattr(wrapper.Matcher, "CELLS", most)
            m = wrapper.Matcher()
            m.measure(a)
            m.measure(b)
            pairs = m._pairs(a.kids, b.kids)
            found.append(([(id(x), id(y)) for x, y in pairs], sum(m.weigh(x.shape, y.shape) + x.size * (x.whole == y.whole) for x, y in pairs)))
        assert found[0][1] == found[1][1] and (cells == 8 or found[0] == found[1])


def test_html_edges(spark, rows):
    df = spark.createDataFrame([(None, "u", "<p>a"), (1, None, None), (1, None, None), (2, "http://[bad", "<p>" + "long " * 100_000)], PAGES).withColumns({"text": F.lit("x"), "host": F.lit("y"), "constants": F.lit(1)})
    assert rows(wrapper.extract(df), "page_id", "n_chars") == [(None, 1), (1, 0), (1, 0), (2, 499_999)]
    assert wrapper.extract(df.limit(0)).isEmpty()


# archives


def sha1(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


ARCHIVED = [(5, "http://a/é", "<p>x</p>"), (3, "http://b/\r\nEvil: 1", "<p>x</p>"), (4, None, None), (9, "u", ""), (7, "u", "\r\n\r\nWARC/1.1 é"), (None, "n", "<p>x</p>"), (8, "u", "y" * 300_000)]


def test_round_trip(spark, rows):
    df = spark.createDataFrame(ARCHIVED, PAGES).withColumns({"key": F.lit(1), "payload": F.lit("z")})
    size = {i: len((h or "").encode()) for i, _, h in ARCHIVED}
    refers = {5: 3, None: 3, 9: 4}
    want = [(i, size[i], sha1(h), "revisit" if i in refers else "response", refers.get(i)) for i, _, h in ARCHIVED]
    got = rows(warc.round_trip(df))
    assert got == sorted(want, key=lambda t: (t[0] is not None, t[0] or 0))


def test_small_payloads_are_responses(spark, rows):
    df = spark.createDataFrame(ARCHIVED, PAGES)
    got = {r.page_id: r.record_type for r in warc.round_trip(df, least=5).collect()}
    assert (got[9], got[4], got[5]) == ("response", "response", "revisit")


def test_payloads_are_stored_once_and_checked(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame([(i, "u", "same") for i in range(50)] + [(60, "u", "other")], PAGES), path)
    assert spark.read.parquet(f"{path}/payloads").count() == 2
    assert warc.read(spark, path).count() == 51
    spoilt = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.lit(b"broken"))
    spoilt.write.parquet(f"{path}/p2")
    Path(f"{tmp_path}/w/payloads").rename(f"{tmp_path}/w/old")
    Path(f"{tmp_path}/w/p2").rename(f"{tmp_path}/w/payloads")
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(spark, path).select("payload").collect()


def test_exported_file_parses(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(ARCHIVED[:5], PAGES), path)
    warc.export(warc.read(spark, path).orderBy("page_id").coalesce(1), f"{path}/out")
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(f"{tmp_path}/w/out").glob("*.warc.gz")))
    seen = []
    while data:
        head, rest = data.split(b"\r\n\r\n", 1)
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        n = int(fields["Content-Length"])
        assert rest[n : n + 4] == b"\r\n\r\n"
        block, data = rest[:n], rest[n + 4 :]
        seen.append((fields["WARC-Type"], len(block.split(b"\r\n\r\n", 1)[1])))
    assert sorted(seen) == sorted([("response", 8), ("revisit", 0), ("response", 0), ("revisit", 0), ("response", len("\r\n\r\nWARC/1.1 é".encode()))])


def test_files_are_read_back(spark, tmp_path, rows):
    """Records through WARC files of a gzip member each: the same bytes, and the same facts."""
    path = f"file://{tmp_path}/w"
    df = spark.createDataFrame([*ARCHIVED, (20, "u", "\x1f\x8b not a member"), (21, "u", "a\r\nX-Page: 5\r\n")], PAGES)
    warc.write(df, path)
    records = warc.read(spark, path)
    warc.export(records.repartition(3), f"{path}/out")
    back = warc.load(spark, f"{path}/out")
    assert sorted(bytes(r.record) for r in back.collect()) == sorted(bytes(r.record) for r in records.collect())
    assert rows(warc.parsed(back)) == rows(warc.parsed(records)) == rows(warc.round_trip(df))
    for file in Path(f"{tmp_path}/w/out").glob("*.warc.gz"):  # a reader may begin at any member
        data = file.read_bytes()
        second = data.find(gzip.compress(b"", mtime=0)) + 20
        assert gzip.decompress(data[second:]) == b"" or gzip.decompress(data[second:]).startswith(b"WARC/1.1\r\n")


def test_spoilt_records_stop(spark, tmp_path):
    path = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame(ARCHIVED[:5], PAGES), path)
    records = warc.read(spark, path)
    for spoil in (F.expr("concat(record, x'20')"), F.expr("substring(record, 1, octet_length(record) - 1)"), F.expr("cast(replace(cast(record as string), '<p>x', '<p>y') as binary)")):
        with pytest.raises(Exception, match="a record is not as long|differs from its record"):
            warc.parsed(records.withColumn("record", spoil)).collect()
    with pytest.raises(Exception, match="not that of the response"):
        warc.parsed(records.where("revisit or page_id <> 3")).collect()


def test_empty_archive(spark):
    assert warc.round_trip(spark.createDataFrame([], PAGES)).isEmpty()


# passages


def item(r, n=220):
    return " ".join("".join(r.choice("abcdefghilmnorstu") for _ in range(r.randrange(2, 9))) for _ in range(n))[:n].strip()


def distance(a, b):
    """Edits from a to the nearest part of b, by the whole table."""
    row = [0] * (len(b) + 1)
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def spoil(r, text, n):
    out = list(text)
    for _ in range(n):
        p, kind = r.randrange(len(out)), r.random()
        if kind < 0.4:
            out[p] = r.choice("qxz")
        elif kind < 0.7:
            del out[p]
        else:
            out.insert(p, r.choice("qxz"))
    return "".join(out)


@pytest.mark.parametrize("seed", range(4))
def test_passages_as_brute_force(seed, monkeypatch):
    monkeypatch.setattr(decontam, "LENGTH", 60)
    monkeypatch.setattr(decontam, "STEP", 60)
    r = random.Random(seed)
    items = [(i, item(r, 60)) for i in range(6)] + [(9, "short one"), (10, item(r, 25))]
    index = decontam.Index(items)
    passages = list(zip(index.item, index.text, index.k.tolist(), strict=True))
    for _ in range(40):
        base = item(r, 150)
        i, p, k = r.choice(passages)
        text = base[:70] + " " + spoil(r, p, r.randrange(0, k + 4)) + " " + base[70:]
        plain = " ".join(text.lower().split())
        want = {j for j, q, most in passages if distance(q, plain) <= most}
        got = index.find(text)
        assert {m[0] for m in got} == want
        for j, begin, end, edits in got:
            q, most = next((q, most) for x, q, most in passages if x == j)
            assert edits == distance(q, plain) and distance(q, re.sub(r"\s+", " ", text[begin:end].lower())) == edits


def test_matches_table(spark, docs, rows, monkeypatch):
    r = random.Random(5)
    a, b = item(r), item(r)
    bench = spark.createDataFrame([(1, a), (2, b), (2, b), (3, None), (None, a), (4, "tiny")], "item_id long, text string")
    df = docs((1, f"x {a.upper()} y"), (2, item(r)), (3, None), (4, ""), (None, b.replace(" ", " \n ")), (6, a[40:200]), (6, a[40:200]), (7, item(r, 200_000) + b), (8, a[:50])).withColumns({"item_id": F.lit(0), "begin": F.lit("b")})
    got = rows(decontam.matches(df, bench), "doc_id", "item_id", "distance")
    assert got == [(None, 2, 0), (1, 1, 0), (6, 1, 0), (6, 1, 0), (7, 2, 0)]
    first = decontam.matches(df.where("doc_id = 1"), bench).first()
    assert (first.begin, first.end) == (2, 66)
    clean = decontam.clean(df, bench)
    assert clean.columns == df.columns and rows(clean, "doc_id") == [(2,), (3,), (4,), (8,)]
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 10)  # a block an item
    assert rows(decontam.matches(df, bench), "doc_id", "item_id", "distance") == got
    assert rows(decontam.clean(df, bench), "doc_id") == [(2,), (3,), (4,), (8,)]
    for empty in (decontam.matches(df.limit(0), bench), decontam.matches(df, bench.limit(0)), decontam.clean(df.limit(0), bench)):
        assert empty.isEmpty()
    assert decontam.clean(df, bench.limit(0)).count() == df.count()


def test_all_regions_are_given():
    r = random.Random(8)
    a, b = item(r, 200), item(r, 64)
    index = decontam.Index([(1, a), (2, b)])
    text = f"{b} {'x' * 100} {a} {'y' * 100} {b.upper()} {a[20:90]}"
    got = index.regions(text)
    assert len(got) == 4 and got[0][3] == 0 and abs(got[0][1] - len(b) - 102) < 2 and abs(got[0][2] - len(b) - 102 - len(a)) < 2
    assert [g[1:] for g in got if g[0] == 2] == [(0, len(b), 0), (text.index(b.upper()), text.index(b.upper()) + len(b), 0)]
    at = len(text) - len(a[20:90])
    assert any(j == 1 and begin <= at and end == len(text) for j, begin, end, _ in got)
    for j, begin, end, edits in got:
        assert edits == 0 and text[begin:end].lower().strip() in (a, b)[j - 1]


def test_slices_and_ranges_lose_nothing(monkeypatch):
    """What is expanded at once is bounded without a difference, also where all items share a q-gram and one item repeats itself."""
    r = random.Random(9)
    same = item(r, 70)
    items = [(i, f"{same} {item(r, 150)}") for i in range(30)] + [(50, (item(r, 40) + " ") * 60), (51, item(r, 3000))]
    texts = [f"{items[3][1]} {same} {items[30][1][200:1400]} {items[31][1][:2500]}", same, spoil(r, items[5][1], 6) * 3, items[30][1]]
    index = decontam.Index(items)
    want = [(index.regions(t), index.find(t)) for t in texts]
    monkeypatch.setattr(decontam, "SLICE", 100)
    monkeypatch.setattr(decontam, "EXPANDED", 2000)
    sizes = []
    expanded = decontam.Index._expanded

    def watched(self, *args):
        for got in expanded(self, *args):
            sizes.append(len(got[0]))
            yield got

    monkeypatch.setattr(decontam.Index, "_expanded", watched)
    assert [(index.regions(t), index.find(t)) for t in texts] == want and all(w[0] for w in want)
    assert len(sizes) > 100


def test_short_items_match_what_is_nothing_else():
    index = decontam.Index([(1, "Yes, it  is"), (2, "42"), (3, " "), (4, "a"), (5, "42")])
    assert index.find("  yes, it is\n")[0][:3] == (1, 2, 12) and [m[0] for m in index.find("42")] == [2, 5] and index.find("\t42 ")[0][:3] == (2, 1, 3)
    assert not index.find("the answer is 42") and not index.find("") and not index.find(" ") and not index.find(None)


def test_table_as_plain_search(spark):
    d = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet").collect()
    norm = lambda t: " ".join(t.lower().split())
    want = {(x.doc_id, b.item_id) for x in docs.collect() for b in bench if norm(b.text) in norm(x.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.matches(docs, spark.read.parquet(f"{d}/benchmark.parquet")).collect()}
    assert want <= got and len(got - want) <= 2


@pytest.mark.parametrize("size", [decontam.RUN, 57, 63, 70, 90])
def test_any_part_of_an_item_of_run_length_is_found(size):
    r = random.Random(size)
    items = [(i, item(r, 300)) for i in range(3)]
    index, plain = decontam.Index(items), " ".join(items[1][1].lower().split())
    for a in range(len(plain) - size + 1):
        part = plain[a : a + size]
        text = f"{'#' * 70}{part}{'#' * 70}"
        assert [m[0] for m in index.find(text)] == [1], a
    assert not index.find("#" * 70 + plain[100 : 100 + decontam.RUN - 1] + "#" * 70)


def test_headline_outside_a_very_long_article_is_kept():
    page = "<body><h1>The headline of it</h1><article>" + "".join(f"<p>paragraph {i}</p>" for i in range(10_001)) + "</article></body>"
    got = [text for _, text in wrapper.blocks(page)]
    assert got[0] == "The headline of it" and len(got) == 10_002
