"""Registered queries of this subpackage and their DuckDB oracles.

Every query applies its operator with production parameters to its whole table. ``ORACLE`` has
SQL where SQL expresses the result; the others are held against brute force in ``tests/llm``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontam, filter_audit, jaccard, langid, licenses, mixing, packing, pii, quality, secret_scan, spelling, url_filter, warc_zip

PII_KEY = "reasonloop-demo-key"       # a demonstration key; a deployment passes its own


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and link-graph verdict of every page's url."""
    return url_filter.judge(_read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document."""
    return langid.identify(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the closest window per item."""
    return decontam.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its personal data replaced."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, PII_KEY).select("doc_id", "n_replaced", "kinds", "text")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    return secret_scan.scan(_read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality features and the cascade's verdict for every document."""
    return quality.measure(_read(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses found in documents, with their places and wording differences."""
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate class, copies and number of links of every document."""
    return jaccard.jaccard_join(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(_read(spark, sf_dir, "documents"))


def op10_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to ZIP-packaged WARC archives and read back."""
    return warc_zip.round_trip(spark, _read(spark, sf_dir, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word of the documents with its near words, form and root."""
    return spelling.spelling_variants(_read(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Figures of every step of every order of the five filters, per source."""
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    return packing.pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (
    op1_url_filter, op2_language_id, op3_decontamination, op4_pii_surrogates, op5_secret_scan, op6_quality_rules,
    op7_license_scan, op8_jaccard_join, op9_source_mix, op10_warc_zip,
    op11_spelling_variants, op12_filter_audit, op13_packing)}


def _pagerank_sql(iterations: int = url_filter.ITERATIONS) -> str:
    d, restart = url_filter.DAMPING, 1 - url_filter.DAMPING
    rounds = [f"s0 as materialized (select kind, host, cast({restart} as double) as score from seeds)"]
    for i in range(1, iterations + 1):
        rounds.append(f"""s{i} as materialized (select kind, host, sum(score) as score from (
            select e.kind, e.b as host, {d} * sum(e.w * s.score) as score from edges e
            join s{i - 1} s on s.kind = e.kind and s.host = e.a group by 1, 2
            union all select * from s0) group by 1, 2)""")
    return ", ".join(rounds)


_OP1 = rf"""
with p0 as (
  select page_id, html,
    case when contains(url, '://') then translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else '' end as host,
    case when contains(url, '://') then regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) else '' end as path
  from pages),
fits as (
  select p.*, r.rule, r.action, length(r.rule) as n from p0 p left join
    (values ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'),
            ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')) r(action, h, pre, rule)
    on (p.host = r.h or ends_with(p.host, '.' || r.h)) and starts_with(p.path, r.pre)),
p as materialized (
  select page_id, any_value(html) as html, any_value(host) as host, any_value(path) as path,
         arg_max(rule, n) as rule, arg_max(action, n) as action from fits group by page_id),
hosts as (
  select host, count(*) as pages, count(*) filter (action = 'block') as blocked, count(*) filter (action = 'allow') as allowed
  from p where host <> '' group by host),
seeds as materialized (
  select case when 2 * blocked > pages then 'distrust' else 'trust' end as kind, host from hosts
  where 2 * blocked > pages or (allowed > 0 and allowed > blocked)),
links as (
  select host as src, lower(unnest(regexp_extract_all(html, '(?i)href=["'']?(?:[a-z]+:)?//([^/?#"''\s>]+)', 1))) as dst from p),
plain as (select src, dst, count(*) as n from links where src <> dst and src <> '' group by 1, 2),
shares as (select src, dst, n / sum(n) over (partition by src) as w from plain),
edges as materialized (select 'trust' as kind, src as a, dst as b, w from shares union all select 'distrust', dst, src, w from shares),
{_pagerank_sql()},
per_host as (
  select host, coalesce(max(score) filter (kind = 'trust'), 0) / {1 - url_filter.DAMPING} as trust,
         coalesce(max(score) filter (kind = 'distrust'), 0) / {1 - url_filter.DAMPING} as distrust from s{url_filter.ITERATIONS} group by host)
select page_id, p.host, path, rule,
  coalesce(action, case when distrust >= {url_filter.THRESHOLD} and distrust > trust then 'block' else 'allow' end) as verdict
from p left join per_host h on h.host = p.host
"""

_OP6 = r"""
with d as materialized (
  select row_number() over () as rid, doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
lines as (select rid, unnest(string_split(text, chr(10))) as line from d),
worded as (select rid, line from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
line_counts as (select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup from worded group by rid),
pos as (select rid, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3),
tri as (select rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from pos),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as c from tri) where c > 1),
covered as (select rid, count(distinct j) as n_repeat from (select rid, unnest([i, i + 1, i + 2]) as j from again) group by rid),
f as (
  select d.rid, doc_id, text, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    length(regexp_replace(text, '[^!?]', '', 'g')) as n_bangs,
    len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) as n_alpha,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup, 0) as n_dup_lines, coalesce(n_repeat, 0) as n_repeat_words
  from d left join line_counts l on l.rid = d.rid left join covered c on c.rid = d.rid)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars,
  cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  (n_words < 50 or 100 * n_repeat_words > 50 * n_words) as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or n_symbols > n_words or n_bangs > n_words
       or 2 * n_dup_lines > n_lines or word_chars < 2 * n_words or word_chars > 40 * n_words or 5 * n_alpha < 2 * n_words) as kept
from f
"""

_OP8 = r"""
with recursive d as materialized (
  select doc_id, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+'), ' ') as words from documents),
cls as materialized (
  select words, min(doc_id) as rep, count(*) as copies, string_split(words, ' ') as w from d where words <> '' group by words),
sh as materialized (
  select distinct rep, g from (
    select rep, unnest(case when len(w) < 5 then [words] else
      list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from cls)),
n as (select rep, count(*) as n from sh group by rep),
inter as (select a.rep as a, b.rep as b, count(*) as c from sh a join sh b on a.g = b.g and a.rep < b.rep group by 1, 2),
link as materialized (
  select a, b from inter join n x on x.rep = a join n y on y.rep = b where c >= 0.8 * (x.n + y.n - c) - 1e-9),
both_ways as materialized (select a, b from link union all select b, a from link),
reach as (select a as s, b as t from both_ways union select r.s, e.b from reach r join both_ways e on e.a = r.t),
low as (select s, least(s, min(t)) as c from reach group by s),
links as (select a, count(*) as k from both_ways group by a)
select d.doc_id, case when d.words = '' then d.doc_id else coalesce(low.c, cls.rep) end as class_id,
  case when d.words = '' then d.doc_id else cls.rep end as copy_id,
  coalesce(cls.copies, 1) as n_copies, coalesce(links.k, 0) as n_links
from d left join cls on cls.words = d.words and d.words <> ''
left join low on low.s = cls.rep left join links on links.a = cls.rep
"""

_OP9 = r"""
with d as materialized (
  select row_number() over () as rid, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size
  from documents),
src as (select source, sum(size)::bigint as s from d group by source),
ranked as (
  select source, s, ([5.0, 2.0, 1.0])[((row_number() over (order by source is null, encode(source))) - 1) % 3 + 1]::double as w from src),
ordered as (
  select *, 2.0::double * s as most, (2.0::double * s) / w as ratio, sum(s) over () as total from ranked),
levels as (
  select *, (1.5::double * total - coalesce(sum(most) over (order by ratio, source is null, encode(source)
      rows between unbounded preceding and 1 preceding), 0.0))
    / sum(w) over (order by ratio, source is null, encode(source) rows between current row and unbounded following) as lev
  from ordered),
goal as (select source, s, least(most, max(lev) over () * w) as target from levels),
cum as (
  select d.*, g.s, g.target, floor(g.target)::bigint as budget,
    case when g.s > 0 then (floor(g.target)::bigint // g.s) else 0 end as epochs,
    coalesce(sum(size) over (partition by d.source order by md5(coalesce(doc_id::varchar, 'null') || ':0:' || size::varchar), doc_id, rid
      rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from d join goal g on d.source is not distinct from g.source)
select doc_id, size::bigint as size, s::bigint as source_size, target,
  (epochs * size + greatest(0, least(size, budget - epochs * s - before)))::bigint as taken
from cum
"""

_OP10 = """
with p as (
  select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages),
k as (select payload_digest, max(page_id) as m from p where payload_bytes >= 1000 group by 1)
select page_id, payload_bytes, p.payload_digest,
  case when payload_bytes >= 1000 and page_id <> m then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> m then m end as refers_to
from p left join k on k.payload_digest = p.payload_digest
"""

_OP12 = r"""
with d as materialized (
  select coalesce(source, '') as part, doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
firsts as (select text, min(doc_id) as first_id from d group by text),
said as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
r as materialized (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    map {'A': len(w) < 50, 'B': 100 * len(list_distinct(w)) < 65 * len(w),
         'C': 100 * length(regexp_replace(d.text, '[^A-Z]', '', 'g')) > 5 * length(d.text),
         'D': regexp_matches(d.text, '[#$%&*|]'), 'E': coalesce(d.doc_id > first_id, false)} as fails
  from d join firsts on firsts.text = d.text left join said on said.doc_id = d.doc_id),
c as materialized (
  select part, list_aggregate(list_transform(['A','B','C','D','E'], lambda x: case when fails[x] then x else '' end), 'string_agg', '') as mask,
         count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from r group by 1, 2),
l as (select unnest(['A','B','C','D','E']) as x),
orders as (
  select a.x || b.x || c.x || d.x || e.x as o from l a, l b, l c, l d, l e
  where a.x <> b.x and a.x <> c.x and a.x <> d.x and a.x <> e.x and b.x <> c.x and b.x <> d.x and b.x <> e.x
    and c.x <> d.x and c.x <> e.x and d.x <> e.x),
steps as (select o, unnest(range(1, 6)) as step from orders),
fate as (
  select part, o, step, substr(o, step, 1) as f, mask, n, good, toxic,
    contains(mask, substr(o, step, 1)) as fails_it,
    regexp_matches(substr(o, 1, step - 1), '[' || mask || '-]') as gone
  from c, steps),
figures as (
  select part, o as filter_order, step, any_value(f) as f,
    sum(case when not gone and not fails_it then n else 0 end) as kept,
    sum(case when not gone and fails_it then n else 0 end) as removed,
    sum(case when gone and fails_it then n else 0 end) as redundant,
    sum(case when mask = f then n else 0 end) as unique_fails,
    sum(case when not gone and fails_it then good else 0 end) as good_lost,
    sum(case when not gone and fails_it then toxic else 0 end) as toxic_lost
  from fate group by part, o, step),
whole as (select part, f, sum(removed) as shapley from figures group by part, f)
select x.part, filter_order, cast(step as integer) as step, cast(kept as bigint) as kept, cast(removed as bigint) as removed,
  cast(redundant as bigint) as redundant, cast(unique_fails as bigint) as unique_fails, cast(good_lost as bigint) as good_lost,
  cast(toxic_lost as bigint) as toxic_lost, cast(shapley as bigint) as shapley
from figures x join whole w on w.part = x.part and w.f = x.f
"""

ORACLE = {"op1_url_filter": _OP1, "op6_quality_rules": _OP6, "op8_jaccard_join": _OP8, "op9_source_mix": _OP9,
          "op10_warc_zip": _OP10, "op12_filter_audit": _OP12}
