"""Queries over documents, pages and goals, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quarrydeck.functions import text as T
from quarrydeck.functions.classify import history_style
from quarrydeck.operators import audit, joins, ranking
from quarrydeck.session import spread
from quarrydeck.sources import snapshots
from quarrydeck.sources.adapters import doc_path, document_files, table

from .registry import query

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_PATH = "source || '/' || lang || '/doc_' || doc_id"
#: The goal of the ranking queries.
ASKED = ["token", "erhe", "thion", "password"]
_TOKENS = f"""
with t as (select doc_id, {_PATH} as path, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9-]+')) as raw from documents),
w as (select doc_id, path, regexp_replace(raw, '^-+|-+$', '', 'g') as term from t),
p as (select path, term, count(*)::double as tf from w where term <> '' and term not in ({_STOP}) group by 1, 2),
dl as (select path, sum(tf) as dl from p group by 1),
st as (select count(*) as n_docs, avg(dl) as avgdl from dl)"""


@query("e11_postings", _TOKENS + " select term, count(*) as df, sum(tf) as tf from p group by 1")
def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.term_counts(document_files(spark, sf_dir))


@query("e11b_corpus_stats", _TOKENS + " select n_docs, round(avgdl, 6) as avgdl from st")
def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = ranking.goal_counts(document_files(spark, sf_dir), []).where("dl > 0")
    return counted.agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("dl"), 6).alias("avgdl"))


_BM25 = (
    _TOKENS
    + """, q as (select unnest(['token', 'erhe', 'thion', 'password']) as term),
df as (select term, count(*) as df from p where term in (select term from q) group by 1),
s as (select p.path, sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * ln((n_docs - df + 0.5) / (df + 0.5) + 1)) as s
  from p join df using (term) join dl using (path), st group by 1)"""
)


@query("e12_bm25", _BM25 + " select path, round(s, 6) as bm25 from s")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25_scores(ranking.goal_counts(document_files(spark, sf_dir), ASKED), ASKED).select("path", F.round("bm25", 6).alias("bm25"))


@query(
    "e12b_near_terms",
    _TOKENS
    + """, q as (select unnest([0, 1, 2]) as pos, unnest(['token', 'secrets', 'anders']) as q),
df as (select q.pos, ln((n_docs - count(p.path) + 0.5) / (count(p.path) + 0.5) + 1) as idf from q left join p on p.term = q.q cross join st group by q.pos, n_docs),
m as (select p.path, pos, tf, case when term = q then 3 when term = q || 's' then 2 when q = term || 's' then 1 when length(term) >= 4 and left(term, 4) = left(q, 4) then 0 end as k from p, q),
h as (select path, pos, max(struct_pack(k := k, w := case when k = 3 then tf when k > 0 then 0.9 * tf else 0.6 * tf end)).w as w from m where k is not null group by 1, 2),
s as (select path, sum(w * 2.2 / (w + 1.2 * (0.25 + 0.75 * dl / avgdl)) * idf) as s, map_from_entries(list((pos, idf))) as hit from h join df using (pos) join dl using (path), st group by 1)
select path, round(s + case when hit[0] is not null and hit[1] is not null then greatest((hit[0] + hit[1]) / 2, 1.5) else 0 end
  + case when hit[1] is not null and hit[2] is not null then greatest((hit[1] + hit[2]) / 2, 1.5) else 0 end, 6) as bm25 from s""",
)
def near_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A goal with near terms and the bonus for pairs of neighbours."""
    tokens = document_files(spark, sf_dir).select("path", F.explode(T.goal_tokens(F.col("content"))).alias("term"), F.lit(1.0).alias("weight"))
    return ranking.bm25(ranking.postings(tokens), ["token", "secrets", "anders"]).select("path", F.round("bm25", 6).alias("bm25"))


@query(
    "rank_intent",
    _BM25
    + f""", b as (select {_PATH} as path, (10 + n_chars // 100)::bigint as score from documents),
r as (select path, (score * (1 + coalesce(s, 0) / (select max(s) from s)))::double as x, score as before from b left join s using (path))
select path, before, trunc(x)::bigint - before as intent, trunc(x)::bigint as score, (row_number() over (order by trunc(x)::bigint desc, path))::integer as rank from r order by trunc(x)::bigint desc, path limit 20""",
)
def rank_intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: files ranked by a structural score and how well they answer a goal; the first twenty."""
    base = table(spark, sf_dir, "documents").select(doc_path().alias("path"), (10 + F.floor(F.col("n_chars") / 100)).cast("long").alias("score"))
    scores = ranking.bm25_scores(ranking.goal_counts(document_files(spark, sf_dir), ASKED), ASKED)
    out = ranking.with_intent(base, scores)
    top = out.select("path", (F.col("score") - F.col("intent")).alias("before"), "intent", "score")
    return joins.ranked(top, [F.desc("score"), "path"], limit=20)


@query(
    "e10_references",
    """
with w as (select distinct doc_id as path, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) as word from documents),
n as (select distinct 1000000 + item_id as path, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as name from benchmark)
select n.path, name, count(distinct w.path) as refs from n join w on w.word = n.name where strlen(name) >= 4 and n.path <> w.path group by 1, 2""",
)
def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents")).select(F.col("doc_id").alias("path"), F.explode(T.identifiers(F.coalesce("text", F.lit("")))).alias("word"))
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000).alias("path"), F.explode(T.identifiers(F.col("text"))).alias("name"))
    return joins.references(d, b)


@query(
    "e13_task_relevance",
    f"""
select path, relevance from (select {_PATH} as path,
  ((case when contains(lower({_PATH}), 'src1') then 8 else 0 end) + (case when contains(lower(source), 'src1') then 5 else 0 end) + (case when contains(lower(coalesce(text, '')), 'src1') then 3 else 0 end)
  + (case when contains(lower({_PATH}), 'token') then 8 else 0 end) + (case when contains(lower(source), 'token') then 5 else 0 end) + (case when contains(lower(coalesce(text, '')), 'token') then 3 else 0 end))::bigint as relevance
from documents) where relevance > 0""",
)
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.task_relevance(document_files(spark, sf_dir), "path", {"path": 8, "package": 5, "content": 3}, ["src1", "token"])


@query(
    "e14_goal_tokens",
    f"""
with t as (select item_id, list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9-]+'), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')), lambda x: x <> '' and not list_contains([{_STOP}], x)) as ts from benchmark),
u as (select item_id, unnest(range(len(ts))) as pos, ts from t)
select item_id, pos::integer as pos, ts[pos + 1] as token, coalesce(ts[pos] in ('not', 'without', 'except', 'no'), false) as negated from u where ts[pos + 1] not in ('not', 'without', 'except', 'no')""",
)
def goal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select("item_id", F.explode(T.signed_tokens(F.col("text"))).alias("t"))
    return b.select("item_id", "t.pos", "t.token", "t.negated")


@query(
    "e27_styles",
    """
select source, n, share, case when share >= 0.8 then 'conventional' when share >= 0.2 then 'mixed' else 'freeform' end as style
from (select source, count(*) as n, round(avg((n_chars > 1500)::integer), 6) as share from documents group by 1)""",
)
def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("n_chars") > 1500).cast("int")), 6).alias("share"))
    return d.withColumn("style", history_style(F.col("share")))


#: Patterns whose meaning is the same in all regular-expression dialects.
PATTERNS = (
    audit.Pattern("email", "security", 9, "[a-z0-9.]+@[a-z0-9]+[.][a-z]+", 0),
    audit.Pattern("secret", "security", 9, '(?:token|secret|password) ?= ?"([A-Za-z0-9_/+.-]{8,})', 1),
    audit.Pattern("licence", "legal", 3, "Licensed under|All rights reserved", 0),
    audit.Pattern("network", "api-contracts", 4, "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}", 0),
)


def _sql_scan() -> str:
    return " union all ".join(f"select path, line, '{p.kind}' as kind, {p.weight} as weight, regexp_extract(text, '{p.regex}', {p.group}) as name from l where regexp_matches(text, '{p.regex}')" for p in PATTERNS)


_LINES = f"""
with f as (select {_PATH} as path, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select path, unnest(range(1, len(ls) + 1)) as line, unnest(ls) as text from f)"""


def _doc_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scan(audit.lines(document_files(spark, sf_dir)), PATTERNS)


@query("e28_pattern_scan", f"{_LINES} select path, line::integer as line, kind, weight, name from ({_sql_scan()})")
def pattern_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doc_hits(spark, sf_dir).select("path", "line", "kind", "weight", "name")


@query(
    "e28b_risk_scores",
    f"""{_LINES}, s as (select path, count(*) as hits, sum(weight) as w from ({_sql_scan()}) group by 1)
select s.path, hits, (w + least((n_chars // 100) // 20, 10))::bigint as score from s join (select {_PATH} as path, n_chars from documents) d on d.path = s.path""",
)
def risk_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(doc_path().alias("path"), F.floor(F.col("n_chars") / 100).cast("long").alias("score"))
    return audit.file_scores(_doc_hits(spark, sf_dir), files)


@query("e28c_script_pages", "select page_id, regexp_matches(html, '<script') as script, len(regexp_extract_all(html, '<p>'))::integer as paragraphs from pages")
def script_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.col("html").rlike("<script").alias("script"), F.size(F.regexp_extract_all("html", F.lit("<p>"), F.lit(0))).alias("paragraphs"))


@query("e29_links", "select link, count(*) as n, count(distinct page_id) as pages from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) as link from pages) group by 1")
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("link"))
    return p.groupBy("link").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


@query(
    "e30_hash_status",
    f"""
with o as (select {_PATH} as path, sha256(coalesce(text, '')) as h from documents where n_chars > 300),
n as (select {_PATH} as path, sha256(case when lang = 'es' then coalesce(text, '') || '!' else coalesce(text, '') end) as h from documents where n_chars < 9000)
select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'deleted' when o.h = n.h then 'fresh' else 'modified' end as status, n.h as sha256
from o full join n on o.path = n.path""",
)
def hash_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = document_files(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    old = d.where("n_chars > 300").select("path", F.sha2("content", 256).alias("sha256"))
    new = d.where("n_chars < 9000").select("path", F.sha2(F.when(F.col("language") == "es", F.concat("content", F.lit("!"))).otherwise(F.col("content")), 256).alias("sha256"))
    return snapshots.status(old, new).join(new, "path", "left").select("path", "status", "sha256")


@query(
    "e33_coverage",
    """
select source, count(*) as files, count(quality) as tested, bool_or(quality is not null) as covered, coalesce(sum(case when quality = 0 then -12 else 0 end), 0)::bigint as penalty
from documents left join labels using (doc_id) group by 1""",
)
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return joins.coverage(d, "source", F.col("quality").isNotNull(), F.when(F.col("quality") == 0, -12).otherwise(0))


@query(
    "e46_call_order",
    "select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as before, strlen(text)::bigint as bytes from conversations",
)
def call_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.lag("role").over(w).alias("before"), F.octet_length("text").cast("long").alias("bytes"))


@query("e47_totals", "select lang, source, count(*) as files, sum(strlen(coalesce(text, '')))::bigint as bytes, sum((strlen(coalesce(text, '')) + 3) // 4)::bigint as tokens from documents group by 1, 2")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = document_files(spark, sf_dir)
    return f.groupBy(F.col("language").alias("lang"), F.col("package").alias("source")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.octet_length("content")).cast("long").alias("bytes"), F.sum(T.token_estimate(F.col("content"))).cast("long").alias("tokens"))


@query(
    "e48_symbol_hash",
    f"""
select {_PATH} as path, len(string_split(coalesce(text, ''), chr(10)))::integer as n_lines, sha256(array_to_string(list_slice(string_split(coalesce(text, ''), chr(10)), 2, 4), chr(10))) as hash from documents""",
)
def symbol_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = document_files(spark, sf_dir).select("path", F.split("content", "\n").alias("ls"))
    return rows.select("path", F.size("ls").alias("n_lines"), F.sha2(F.array_join(F.slice("ls", 2, 3), "\n"), 256).alias("hash"))


@query(
    "e49_redaction",
    f"""
select {_PATH} as path, regexp_replace(regexp_replace(coalesce(text, ''), '/(?:home|Users)/[A-Za-z0-9._-]+', '<redacted>', 'g'), '(?i)((?:api[_-]?key|token|secret|password|passwd)[ \\t\\n\\f\\r]*[:=][ \\t\\n\\f\\r]*["'']?)[A-Za-z0-9_/+.-]{{8,}}', '\\1<redacted>', 'g') as text
from documents""",
)
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_files(spark, sf_dir).select("path", T.redact(F.col("content")).alias("text"))
