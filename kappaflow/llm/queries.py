"""Registered queries of the operators and their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kappaflow.llm import (decontamination, dimension_scan, exact_dedup, hard_negatives, importance, line_dedup,
                           odd_minhash, packing, perspectives, prefix_trie, token_cache, toxicity_crf, url_filters)
from kappaflow.llm.common import Scratch, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op7_token_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of whole texts; the cache starts empty, in a new folder of
    shared storage, so every run encodes all distinct contents."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    counts = token_cache.count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"),
                                      Scratch(spark, "token-cache").root)
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@query
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packing of whole documents into sequences of 2048 ids; the operator
    keeps the ids, the query gives the CRC-32 of each piece's."""
    import public_tokenizers

    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048)
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines and which of them go (numbers from 0)."""
    docs = table(spark, sf_dir, "documents")
    gone = line_dedup.removed_lines(docs)
    rows = docs.selectExpr("doc_id", f"coalesce(doc_id, {line_dedup.NO_ID}L) as doc", "xxhash64(coalesce(text, '')) as tk",
                           "size(split(coalesce(text, ''), '\\n')) as n_lines")
    return rows.join(gone, ["doc", "tk"], "left").selectExpr(
        "doc_id", "n_lines", "coalesce(size(removed), 0) as n_removed",
        "coalesce(array_join(removed, ','), '') as removed")


ORACLE["op1_line_dedup"] = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, generate_subscripts(ls, 1) - 1 as line_no, unnest(ls) as line from d),
s as (select doc_id, line_no, list_sort(list_distinct(list_filter(
        string_split_regex(line, '[ \t\v\f\r]'), lambda w: w <> ''))) as ws from l),
c as (select ws, len(ws) as n, min((coalesce(doc_id, 9223372036854775807), line_no)) as first
      from s where len(ws) > 0 group by ws),
t as (select ws, n, first, unnest(ws) as w from c),
f as (select w, count(*) as k from t group by w),
o as (select t.ws, t.n, t.first, t.w, row_number() over (partition by t.ws order by f.k, t.w) as p from t join f on t.w = f.w),
h as (select * from o where p <= n - ceil(0.8 * n - 1e-9) + 1),
e as (select distinct a.ws as ws, b.ws as other from h a join h b
      on a.w = b.w and b.first < a.first and b.n <= a.n / 0.8 + 1e-9 and b.n >= 0.8 * a.n - 1e-9),
m as (select ws, len(ws) + len(other) as total, len(list_intersect(ws, other)) as common from e),
g as (select distinct ws from m where common >= 0.8 * (total - common) - 1e-9),
r as (select s.doc_id, s.line_no from s join c on s.ws = c.ws left join g on s.ws = g.ws
      where g.ws is not null or (coalesce(s.doc_id, 9223372036854775807), s.line_no) <> c.first),
p as (select doc_id, count(*) as n_removed, string_agg(line_no, ',' order by line_no) as removed from r group by doc_id)
select d.doc_id, cast(len(ls) as int) as n_lines, cast(coalesce(n_removed, 0) as int) as n_removed,
  coalesce(removed, '') as removed
from d left join p on d.doc_id = p.doc_id
"""


@query
def op8_odd_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of whole documents."""
    return odd_minhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id", "kept")


@query
def op2_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every participant's side, as segments."""
    return perspectives.rotate(table(spark, sf_dir, "conversations"))


ORACLE["op2_perspectives"] = """
with t as (select conv_id, turn, coalesce(role, 'unknown') as speaker, coalesce(text, '') as text from conversations),
p as (select distinct conv_id, speaker as perspective from t where speaker <> 'system'),
h as (select t.*, p.perspective, case when speaker = 'system' then '<|system|>'
        when speaker = perspective then '<|assistant|>' else '<|user:' || speaker || '|>' end || chr(10) as header
      from t join p on t.conv_id is not distinct from p.conv_id),
s as (select *, header || text || '<|end|>' || chr(10) as segment from h),
o as (select *, length(segment) as chars,
        row_number() over (partition by conv_id, perspective order by turn nulls last, speaker, text) - 1 as seq,
        sum(length(segment)) over (partition by conv_id, perspective order by turn nulls last, speaker, text
          rows between unbounded preceding and current row) as e
      from s)
select conv_id, perspective, seq, turn, speaker, segment, cast(e - chars as bigint) as start, cast(e as bigint) as "end",
  cast(case when speaker = perspective then e - chars + length(header) end as bigint) as mask_start,
  cast(case when speaker = perspective then e end as bigint) as mask_end
from o
"""


@query
def op4_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five nearest vectors of every fiftieth vector."""
    return dimension_scan.nearest(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", k=5, dim=64)


# Fetch times and the dated list are derived from `pages` (which has neither)
# with the same md5 arithmetic in both engines.
_DAY = "cast(conv(substr(md5({x}), 1, 7), 16, 10) as bigint) % {m}"


@query
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page capture against a dated list: each host has three entries,
    each domain two, each URL four."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    day = lambda x, m: F.expr(f"date_add(date'2024-01-01', cast({_DAY.format(x=x, m=m)} as int))")
    captures = pages.withColumn("fetched", day("concat('fetch', cast(page_id as string))", 366))
    made = []
    for kind, n in (("host", 3), ("domain", 2), ("url", 4)):
        names = pages.select(url_filters.entity(kind, F.col("url")).alias("entity")).dropna().distinct()
        made.append(names.selectExpr(f"'{kind}' as kind", "entity", f"explode(sequence(1, {n})) as j"))
    rows = made[0].unionByName(made[1]).unionByName(made[2])
    entries = rows.select(
        "kind", "entity", day("concat(kind, entity, cast(j as string))", 366).alias("listed_on"),
        F.expr("case " + _DAY.format(x="concat('act', kind, entity, cast(j as string))", m=3)
               + " when 0 then 'block' when 1 then 'allow' else 'drop' end").alias("action"))
    return url_filters.evaluate(captures, entries)


ORACLE["op10_url_filters"] = r"""
with n as (select page_id, url, nullif(regexp_replace(lower(
      regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '\.$', ''), '') as host,
    regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#]*', ''), '#.*$', '') as rest from pages),
c as (select page_id, url, host, host || rest as u, nullif(regexp_extract(host, '([^.]+\.[^.]+)$', 1), '') as dom,
    date '2024-01-01' + cast(('0x' || substr(md5('fetch' || page_id), 1, 7))::bigint % 366 as int) as fetched from n),
x as (select distinct 'host' as kind, host as entity, unnest([1, 2, 3]) as j from c where host is not null
  union all select distinct 'domain', dom, unnest([1, 2]) from c where dom is not null
  union all select distinct 'url', u, unnest([1, 2, 3, 4]) from c where u is not null),
e as (select kind, entity, date '2024-01-01' + cast(('0x' || substr(md5(kind || entity || j), 1, 7))::bigint % 366 as int) as d,
    ('0x' || substr(md5('act' || kind || entity || j), 1, 7))::bigint % 3 as r from x),
g as (select kind, entity, d, min(r) as r from e group by all),
i as (select *, lead(d) over (partition by kind, entity order by d) as until from g),
v as (select kind, entity, case r when 0 then 'block' else 'allow' end as decision, d, until from i where r < 2),
m as (select c.*, coalesce(a.kind, b.kind, f.kind) as kind,
    case when a.kind is not null then a.decision when b.kind is not null then b.decision else coalesce(f.decision, 'none') end as decision,
    case when a.kind is not null then a.d when b.kind is not null then b.d else f.d end as valid_from,
    case when a.kind is not null then a.until when b.kind is not null then b.until else f.until end as valid_to
  from c left join v a on a.kind = 'url' and a.entity = c.u and a.d <= fetched and (a.until is null or fetched < a.until)
  left join v b on b.kind = 'host' and b.entity = c.host and b.d <= fetched and (b.until is null or fetched < b.until)
  left join v f on f.kind = 'domain' and f.entity = c.dom and f.d <= fetched and (f.until is null or fetched < f.until))
select page_id, url, fetched, decision, kind, valid_from, valid_to from m
"""


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a test item, with the exact containment."""
    found = decontamination.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", F.round("containment", 9).alias("containment"))


ORACLE["op6_decontamination"] = r"""
with d as (select doc_id as id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\v\f\r]'), lambda w: w <> '') as ws
  from documents),
b as (select item_id as id, list_filter(string_split_regex(lower(coalesce(text, '')), '[ \t\n\v\f\r]'), lambda w: w <> '') as ws
  from benchmark),
q as (select distinct id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3),
    lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from b),
z as (select distinct len(ws) as z from b where len(ws) between 1 and 4),
s as (select id, unnest(case when len(ws) >= 5 then list_transform(range(1, len(ws) - 3),
    lambda i: array_to_string(ws[i:i + 4], ' ')) when len(ws) > 0 then [array_to_string(ws, ' ')] else [] end) as g from d
  union select id, unnest(list_transform(range(1, len(ws) - z + 2), lambda i: array_to_string(ws[i:i + z - 1], ' '))) as g
  from d join z on len(ws) > z),
n as (select id, count(*) as n from q group by id),
m as (select s.id as doc_id, q.id as item_id, count(*) as k from s join q on s.g = q.g group by all)
select doc_id, item_id, cast(k as int) as n_shared, cast(n.n as int) as n_item, round(k / n.n, 9) as containment
from m join n on m.item_id = n.id where k >= n.n - floor(0.25 * n.n + 1e-9)
"""


@query
def op5_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents and the Gumbel top-k sample; the
    target model is counted over the documents labelled good."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return importance.resample(table(spark, sf_dir, "documents"), good).select(
        "doc_id", "log_weight", "gumbel_key", "kept")


@query
def op3_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of whole documents; labels with crc32(doc_id) mod 5 = 0 are
    held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = toxicity_crf.fit(docs, labels.filter(~held_out).select("doc_id", "toxic"))
    return toxicity_crf.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_toxic",
        F.array_join(F.transform("spans", lambda s: F.concat(s["start"].cast("string"), F.lit("-"), s["end"].cast("string"))),
                     ";").alias("spans"))


@query
def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of texts that are equal but for the case of A-Z; the largest
    doc_id of a group stays."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE["op13_exact_dedup"] = """
with d as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t
  from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(t) as text_sha256 from d join g using (t)
"""


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prefix trie of all conversations, rebuilt to share their openings."""
    scratch = Scratch(spark, "prefix-trie")
    numbered = prefix_trie.numbered_turns(table(spark, sf_dir, "conversations"), scratch)
    return prefix_trie.trie(*prefix_trie.with_openings(numbered, scratch), scratch)


# DuckDB has no CRC-32, so the twin makes its table from the polynomial
ORACLE["op12_prefix_trie"] = """
with z as (select list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, b: case when a % 2 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)) as tab),
o as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id
    order by turn nulls first, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as pos
  from conversations where conv_id is not null),
n as (select conv_id, max(pos) as n from o group by conv_id),
h as (select conv_id, n, conv_id - conv_id % 100 as base, xor(4294967295, list_reduce(
      [4294967295] || list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i::bigint, 1))::bigint),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]))) % 6 as h from n, z),
t as (select h.*, least(h, coalesce(b.n, 0)) as taken from h left join n b on h.base = b.conv_id),
r as (select t.conv_id, o.pos as d, o.role, o.text from t join o on o.conv_id = t.base where o.pos <= t.h
  union all select t.conv_id, o.pos - t.h + t.taken, o.role, o.text from t join o on o.conv_id = t.conv_id where o.pos > t.h),
k as (select conv_id, d, length(text) as chars, md5(string_agg(md5(strlen(role) || ':' || role || text), '')
    over (partition by conv_id order by d)) as key from r),
m as (select conv_id, d, chars, key from k union all select conv_id, 0, 0, 'root' from t),
g as (select d, key, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars from m group by d, key),
u as (select d, key, max(d) over (partition by conv_id) = d as ended, conv_id from m),
e as (select d, key, string_agg(conv_id, ',' order by conv_id) as ids from u where ended group by d, key),
p as (select g.d, g.key, m.key as pkey from g join m on m.conv_id = g.conv_id and m.d = g.d - 1),
c as (select d - 1 as d, pkey as key, count(*) as n_children from p group by all),
s as (select g.*, coalesce(n_children, 0) as n_children from g left join c using (d, key)),
a as (select m.d, m.key, sum(case when s.n_children = 0 then 1 else 0 end) as n_leaves, sum((s.n_convs - 1) * s.chars) as saved
  from s join m on m.conv_id = s.conv_id and m.d <= s.d group by m.d, m.key)
select s.conv_id, s.d as depth, q.conv_id as parent_conv_id, s.n_convs, s.n_children, a.n_leaves::bigint as n_leaves,
  a.saved::bigint as saved_tokens, sha256(coalesce(e.ids, '')) as ends_sha256
from s join a using (d, key) left join e using (d, key) left join p using (d, key) left join s q on q.d = s.d - 1 and q.key = p.pkey
"""


@query
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every fiftieth vector; every seventh row moves to the
    next label first."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").withColumn("label", label), "vec_id % 50 = 0")


ORACLE["op11_hard_negatives"] = """
with e as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
s as (select a.vec_id as anchor_id, a.label as la, b.vec_id, b.label as lb, list_inner_product(a.q, b.q)::bigint as score
  from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where la = lb
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, positive_id, cast(row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) as int) as rank,
  vec_id as negative_id, positive_score, score as negative_score
from p join s on s.anchor_id = p.anchor_id and la <> lb and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify row_number() over (partition by p.anchor_id, positive_id order by score desc, vec_id) <= 3
"""
