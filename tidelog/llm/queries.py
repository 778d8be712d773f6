"""One query for each operator of this subpackage, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from . import decontam, langid, lines, lm, minhash, pieces, quality, search, warc, wrapper
from .common import dealt
from .common import table as scan


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return dealt(scan(spark, sf_dir, name))


def op1_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every row whose id is divisible by 100, against all rows."""
    docs = table(spark, sf_dir, "documents")
    return search.search(docs, docs.where("doc_id % 100 = 0"), k=10)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = pieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), model))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, scan(spark, sf_dir, "labels")))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrapper.extract(table(spark, sf_dir, "pages"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.matches(table(spark, sf_dir, "documents"), scan(spark, sf_dir, "benchmark"), every=True)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses to six places, as sums of logarithms depend on their order in the last ones."""
    docs = table(spark, sf_dir, "documents")
    out = lm.score(docs, lm.count(docs, scan(spark, sf_dir, "labels")))
    losses = ("target_loss", "background_loss", "difference")
    return out.select("doc_id", "n_tokens", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in losses))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (
    op1_bm25_search, op2_line_dedup, op3_sentencepiece, op4_quality, op5_html_extraction, op6_minhash_near_dedup, op7_language_id,
    op8_decontamination, op9_lm_score, op10_warc
)}
#: Lines and their words, pairs of neighbouring lines and long lines, those of which an equal one stands earlier, and the runs of lines
#: that they cover.
LINE_DEDUP = """
    with line as (select doc_id, unnest(string_split(text, chr(10))) as l, generate_subscripts(string_split(text, chr(10)), 1) as i from {docs}),
    worded as (select *, case when l = '' then 0 else length(l) - length(replace(l, ' ', '')) + 1 end as words, lead(l) over (partition by doc_id order by i) as next from line),
    unit as (select doc_id, i, 2 as n, l || chr(10) || next as body from worded where next is not null union all select doc_id, i, 1, l from worded where words >= 50),
    copy as (select * from unit qualify row_number() over (partition by n, body order by doc_id, i) > 1),
    covered as (select doc_id, i from copy union select doc_id, i + 1 from copy where n = 2),
    numbered as (select doc_id, i, words, i - row_number() over (partition by doc_id order by i) as run from covered join worded using (doc_id, i)),
    gone as (select doc_id, i, run from numbered qualify sum(words) over (partition by doc_id, run) >= 50),
    rebuilt as (select doc_id, coalesce(string_agg(l, chr(10) order by i) filter (g.run is null), '') as text, count(distinct g.run) as n_removed from line left join gone g using (doc_id, i) group by doc_id),
    line_dedup as (select d.doc_id, case when d.text is null then null else r.text end as text, d.lang, d.source, d.n_chars, coalesce(r.n_removed, 0)::bigint as n_removed
                   from {docs} d left join rebuilt r using (doc_id))"""

#: SHA-1 of DuckDB is hexadecimal; each five bits are a letter of RFC 4648's alphabet.
ORACLE_SQL: dict[str, str] = {
    "op1_bm25_search": """
        with w as (select doc_id, unnest(list_filter(string_split_regex(lower(text), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda x: x <> '')) as term from documents),
        tf as (select doc_id, term, count(*) as n from w group by all),
        len as (select d.doc_id, coalesce(sum(n), 0) as dl from documents d left join tf using (doc_id) group by 1),
        stat as (select count(*) as rows, sum(dl) / count(*) as mean from len),
        idf as (select term, ln(1 + (rows - count(*) + 0.5) / (count(*) + 0.5)) as idf from tf, stat group by term, rows),
        s as (select q.doc_id as query_id, t.doc_id, round(sum(idf * t.n * 2.2 / (t.n + 1.2 * (0.25 + 0.75 * dl / mean))), 6) as score
              from tf q join tf t using (term) join idf using (term) join len on len.doc_id = t.doc_id, stat where q.doc_id % 100 = 0 group by all)
        select query_id, row_number() over (partition by query_id order by score desc, doc_id)::bigint as rank, doc_id, score from s qualify rank <= 10""",
    "op2_line_dedup": LINE_DEDUP.format(docs="documents") + " select doc_id, text, lang, source, n_chars, n_removed from line_dedup",
    # shingles of three words, all pairs of documents that share one, and what is reachable over links
    "op6_minhash_near_dedup": """
        with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents),
        places as (select doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) as i from w where len(words) > 0),
        shingle as (select distinct doc_id, array_to_string(words[i:i + 2], ' ') as s from places),
        size as (select d.doc_id, count(s) as n from documents d left join shingle using (doc_id) group by 1),
        met as (select a.doc_id as a, b.doc_id as b, count(*) as n from shingle a join shingle b on a.s = b.s and a.doc_id < b.doc_id group by all),
        link as (select a, b from met join size x on x.doc_id = a join size y on y.doc_id = b where 100 * met.n >= 85 * (x.n + y.n - met.n)),
        edge as (select a, b from link union all select b, a from link),
        reach as (select doc_id as a, doc_id as b from documents union select r.a, e.b from reach r join edge e on r.b = e.a),
        component as (select a as doc_id, min(b) as component_id from reach group by 1)
        select doc_id, n as n_shingles, component_id, doc_id = component_id as kept from size join component using (doc_id)""",
    # a word's and a pair's counts in rated and in all texts; 131072, 0.5 and 4 are lm.VOCABULARY, FLOOR and MASS
    "op9_lm_score": """
        with w as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x2f\\x3a-\\x40\\x5b-\\x60\\x7b-\\x7f]+'), lambda x: x <> '') as words from documents),
        tok as (select doc_id, unnest(words) as term, generate_subscripts(words, 1) as i from w),
        pair as (select *, lag(term) over (partition by doc_id order by i) as prev from tok),
        good as (select doc_id from labels group by 1 having max(quality) > 0 and coalesce(max(toxic), 0) = 0),
        marked as (select p.*, g.doc_id is not null as is_target from pair p left join good g using (doc_id)),
        one as (select term, count(*) as n, count(*) filter (is_target) as t from marked group by 1),
        two as (select prev, term, count(*) as n, count(*) filter (is_target) as t from marked where prev is not null group by 1, 2),
        total as (select coalesce(sum(n), 0) as n, coalesce(sum(t), 0) as t, greatest(131072, count(*)) as v from one),
        p as (select m.doc_id, m.i, h.n as hn, h.t as ht, two.n as bn, two.t as bt, (o.n + 0.5) / (total.n + 0.5 * v) as pn, (o.t + 0.5) / (total.t + 0.5 * v) as pt
              from marked m join one o using (term) join total on true left join one h on h.term = m.prev left join two on two.prev = m.prev and two.term = m.term),
        loss as (select doc_id, count(*) as n_tokens, avg(-ln((coalesce(bt, 0) + 4 * pt) / (coalesce(ht, 0) + 4))) as t, avg(-ln((coalesce(bn, 0) + 4 * pn) / (coalesce(hn, 0) + 4))) as b from p group by 1)
        select d.doc_id, coalesce(n_tokens, 0)::bigint as n_tokens, round(t, 6) + 0.0 as target_loss, round(b, 6) + 0.0 as background_loss, round(t - b, 6) + 0.0 as difference
        from documents d left join loss using (doc_id)""",
    "op10_warc": """
        with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
        d as (select page_id, octet_length(payload)::bigint as payload_bytes, sha1(payload) as h, min(page_id) over (partition by sha256(payload)) as response from p)
        select page_id, payload_bytes,
               list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   1 + ((('0x' || substr(h || '00', 1 + (5 * i) // 4, 3))::integer >> (7 - (5 * i) % 4)) & 31), 1) for i in range(0, 32)], 'string_agg', '') as payload_digest,
               case when page_id = response then 'response' else 'revisit' end as record_type,
               case when page_id <> response then response end as refers_to
        from d""",
}
