"""Registered queries of the operators in this package, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddlot.llm.containment import contained_items
from oddlot.llm.hard_negatives import hard_negatives
from oddlot.llm.interleave import interleaved_shards
from oddlot.llm.lattice import near_vectors
from oddlot.llm.licences import licensed_paragraphs
from oddlot.llm.merkle import archived, audit
from oddlot.llm.packing import pack_sequences
from oddlot.llm.parity_join import jaccard_components
from oddlot.llm.prefix_hash import edited_fingerprints
from oddlot.llm.quality import quality_scores
from oddlot.llm.recompression import remove_repeats
from oddlot.llm.spelling import spelling_forms
from oddlot.llm.url_list import decided

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return keep


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# The words of a text as a list; ``lowered`` folds A-Z only.
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op1_ngram_jaccard_join",
    f"""
    with recursive w as (select doc_id, {WORDS.format(LOWERED)} as w from documents),
    s as materialized (
      select distinct doc_id, unnest(case when len(w) = 0 then []
             when len(w) < 4 then [w]
             else list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3]) end) as s from w),
    n as (select w.doc_id, count(s.s) as n from w left join s using (doc_id) group by 1),
    e as materialized (
      select a.doc_id as a, b.doc_id as b from s a join s b on a.s = b.s and a.doc_id <> b.doc_id
      join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
      group by a.doc_id, b.doc_id, x.n, y.n
      having 100 * count(*) >= 85 * (x.n + y.n - count(*))),
    r as (select doc_id as d, doc_id as c from w union select r.d, e.b from r join e on r.c = e.a)
    select n.doc_id, n.n as n_shingles, m.c as component_id
    from n join (select d, min(c) as c from r group by 1) m on m.d = n.doc_id""",
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"), k=4, percent=85)


@query(
    "op10_recompression_dedup",
    f"""
    with w as materialized (select doc_id, {WORDS.format("coalesce(text, '')")} as w from documents),
    p as materialized (
      select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h
      from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from w)),
    f as (select h, min(doc_id) as d from p group by h),
    g as (select doc_id, list(i) as starts from p join f using (h) where p.doc_id > f.d group by doc_id),
    c as (select doc_id, unnest(starts) as i from g),
    r as (select distinct doc_id, i + o as pos from c cross join (select unnest(range(50)) as o)),
    k as (
      select doc_id, count(*) as n, list(pos) as gone from r group by doc_id)
    select w.doc_id, len(w.w) as n_words, coalesce(k.n, 0) as n_removed,
           sha256(array_to_string(case when k.n is null then w.w
             else list_transform(list_sort(list_filter(range(1, len(w.w) + 1), lambda x: not list_contains(k.gone, x))),
                                 lambda x: w.w[x]) end, ' ')) as kept_sha256
    from w left join k using (doc_id)""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeats(table(spark, folder, "documents"))


@query(
    "op8_benchmark_containment",
    f"""
    with d as (select doc_id, {WORDS.format(LOWERED)} as w from documents),
    b as (select item_id, {WORDS.format(LOWERED)} as w from benchmark),
    ds as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w]
           else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as s from d),
    bs as (select distinct item_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [w]
           else list_transform(range(1, len(w) - 3), lambda i: w[i:i + 4]) end) as s from b),
    n as (select item_id, count(*) as n from bs group by 1)
    select doc_id, item_id, n as n_item, count(*) as n_shared
    from ds join bs using (s) join n using (item_id)
    group by doc_id, item_id, n having 100 * count(*) >= 80 * n""",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op3_quality_classifier")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op4_packing")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return pack_sequences(table(spark, folder, "documents"))


@query(
    "op5_temporal_url_filter",
    r"""
    with h as (
      select distinct regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1) as host from pages where url is not null),
    m as (select host, md5(host) as m, md5('p:' || host) as p from h where host <> ''),
    d as (
      select host, m, p, ascii(substr(m, 2, 1)) % 16 * 15 as a, (ascii(substr(m, 3, 1)) % 16 + 1) * 7 as b from m),
    e as (
      select host as key, 'add' as act, timestamp '2024-01-01' + to_days(a) as t from d where substr(m, 1, 1) < '4'
      union all
      select host, 'remove', timestamp '2024-01-01' + to_days(a + b) from d where substr(m, 1, 1) < '4'
      union all
      select host, 'add', timestamp '2024-01-01' + to_days(a + b + 30) from d
      where substr(m, 1, 1) < '4' and substr(m, 4, 1) < '8'
      union all
      select host || '/en', 'add', timestamp '2024-01-01' + to_days(a) from d where substr(p, 1, 1) < '8'),
    i as (
      select * from (select key, act, t as since, lead(t) over (partition by key order by t, act) as until from e)
      where act = 'add' and (until is null or until > since)),
    c as (
      select page_id, url, timestamp '2024-01-01' + to_hours((page_id * 7919) % 8784) as f, count(*) as n_rows
      from pages group by 1, 2, 3),
    k as (
      select page_id, url, f, string_split(regexp_replace(regexp_replace(
               regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', ''), '.') as l,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^/?#]*)', 1) as s
      from c where url is not null),
    a as (
      select page_id, url, f, unnest(list_distinct(list_concat(
        list_transform(range(1, greatest(len(l) - 1, 1) + 1), lambda j: array_to_string(l[j:], '.')),
        [array_to_string(l, '.') || s]))) as key from k),
    g as (
      select page_id, url, f, key, row_number() over (partition by page_id, url, f order by length(key) desc, key desc) as r
      from a join i using (key) where since <= f and (until is null or f < until))
    select c.page_id, c.url, strftime(c.f, '%Y-%m-%d %H:%M:%S') as fetched_at, c.n_rows,
           g.key is not null as blocked, g.key as matched_key
    from c left join g on g.r = 1 and c.page_id is not distinct from g.page_id and c.url = g.url and c.f = g.f""",
)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Pages carry no time and the tables no list, so both are derived: a capture's hour from its id, and
    a dated list from hashes of the hosts that occur."""
    pages = table(spark, folder, "pages").select("page_id", "url")
    start = "timestamp_ntz'2024-01-01 00:00:00'"
    captures = pages.withColumn(
        "fetched_at", F.expr(f"{start} + make_dt_interval(0, cast(pmod(page_id * 7919, 8784) as int))")
    )
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    hosts = pages.select(host.alias("host")).filter("host <> ''").distinct()
    dated = hosts.withColumns({"m": F.md5("host"), "p": F.md5(F.concat(F.lit("p:"), "host"))}).withColumns(
        {
            "a": F.expr("ascii(substr(m, 2, 1)) % 16 * 15"),
            "b": F.expr("(ascii(substr(m, 3, 1)) % 16 + 1) * 7"),
        }
    )
    day = lambda days: F.expr(f"{start} + make_dt_interval({days})")
    listed = dated.filter("substr(m, 1, 1) < '4'")
    entries = (
        listed.select(F.col("host").alias("key"), F.lit("add").alias("action"), day("a").alias("at"))
        .union(listed.select("host", F.lit("remove"), day("a + b")))
        .union(listed.filter("substr(m, 4, 1) < '8'").select("host", F.lit("add"), day("a + b + 30")))
        .union(dated.filter("substr(p, 1, 1) < '8'").select(F.concat("host", F.lit("/en")), F.lit("add"), day("a")))
    )
    return decided(captures, entries).withColumn("fetched_at", F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss"))


@query("op6_stratified_interleaving")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return interleaved_shards(table(spark, folder, "documents"))


@query(
    "op7_merkle_fixity",
    r"""
    with r as (
      select page_id, page_id // 500 as archive, url,
             'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: '
             || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10)
             || chr(13) || chr(10) || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) as record
      from pages),
    o as (
      select *, strlen(record) as length,
             coalesce(sum(strlen(record)) over (partition by archive order by page_id, url, sha256(record)
                                                rows between unbounded preceding and 1 preceding), 0) as start
      from r)
    select archive, cast(start as bigint) as "offset", length, page_id as record_id,
           case when page_id % 211 = 5 then 'missing' else 'altered' end as kind
    from o where page_id % 97 = 13 or page_id % 211 = 5""",
)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The pages as archived against a replica of them with damage derived from their ids: some digests
    are those of altered bytes, some records are lost."""
    records = archived(table(spark, folder, "pages"))
    left = records.select("archive", "offset", "length", F.col("page_id").alias("record_id"), "digest")
    damaged = F.when(F.col("record_id") % 97 == 13, F.sha2(F.concat("digest", F.lit("!")), 256)).otherwise(F.col("digest"))
    right = left.withColumn("digest", damaged).filter("record_id is null or record_id % 211 <> 5")
    return audit(left, right)


@query(
    "op9_lattice_neighbours",
    """
    with recursive v as materialized (
      select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
    p as materialized (
      select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id
      where list_cosine_similarity(a.e, b.e) >= 0.95),
    r as (select vec_id as d, vec_id as c from v union select r.d, p.b from r join p on r.c = p.a),
    n as (select a, count(*) as n from p group by a),
    m as (select d, min(c) as c from r group by d)
    select vec_id, coalesce(n.n, 0) as n_links, m.c as component_id, vec_id = m.c as kept
    from v join m on m.d = v.vec_id left join n on n.a = v.vec_id""",
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@query("op2_licence_scan")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return licensed_paragraphs(table(spark, folder, "documents"))


@query("op11_prefix_fingerprints")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return edited_fingerprints(table(spark, folder, "documents"))


@query(
    "op12_spelling_trie",
    r"""
    with recursive t as materialized (
      select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
             lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc),
    r as materialized (
      select d, w, count(*) as n from (
        select doc_id as d, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents)
      where length(w) >= 5 group by d, w),
    b as (
      select d, w, n, flatten(list_transform(string_split(coalesce(d::varchar, '') || ':' || w, ''),
             lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x)::bigint - 64] end)) as bytes from r),
    h as (
      select w, n, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, bytes),
             lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1]))) as h from b, t),
    o as (
      select case when h % 97 = 0 then substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) else w end as word, n from h),
    v as materialized (
      select word, sum(n)::bigint as n from o where length(word) >= 5 group by word having sum(n) >= 3),
    c as materialized (
      select word, n, substr(word, 1, i - 1) as x, substr(word, i + 1) as y
      from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
    p as (
      select distinct a.word as a, a.n as a_n, b.word as b, b.n as b_n
      from c a join c b on a.x = b.x and a.y = b.y and a.word <> b.word
      union
      select c.word, c.n, v.word, v.n from c join v on c.x || c.y = v.word),
    q as (select a, a_n, b, b_n from p union select b, b_n, a, a_n from p),
    f as (
      select a, count(*) as n_near, first(b order by b_n desc, b) as best, max(b_n) as best_n from q group by a),
    g as materialized (
      select word, n, coalesce(n_near, 0) as n_near, case when best_n >= 2 * n then best end as form,
             case when best_n >= 2 * n then best_n end as form_n
      from v left join f on f.a = v.word),
    s as (select word, word as root, form as next from g
          union all select s.word, g.word, g.form from s join g on s.next = g.word)
    select g.word, g.form, s.root, g.n, g.n_near, g.form_n from g join s on s.word = g.word and s.next is null""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return spelling_forms(table(spark, folder, "documents"))


@query(
    "op13_tree_bounded_negatives",
    """
    with v as materialized (
      select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
             list_transform(embedding, lambda x: floor(256 * x::double)) as q
      from embeddings
      where label is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    s as materialized (
      select a.vec_id as a, a.label as al, b.vec_id as b, b.label as bl, list_dot_product(a.q, b.q)::bigint as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
    p as (
      select * from (select a, b, score, row_number() over (partition by a order by score desc, b) as r from s where al = bl)
      where r <= 5),
    n as (
      select p.a, p.b as p, p.score as p_score, s.b as n, s.score as n_score,
             row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank
      from p join s on p.a = s.a and s.al <> s.bl and 80 * p.score <= 100 * s.score and 100 * s.score <= 100 * p.score)
    select a as anchor_id, p as positive_id, rank::integer as rank, n as negative_id, p_score as positive_score,
           n_score as negative_score
    from n where rank <= 5""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """A seventh of the labels is moved on by one, so that near vectors of another label exist."""
    rows = table(spark, folder, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
