"""Queries of the renderers: parts as ranked files, their line items as symbols and callers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrydeck.functions import text as T
from quarrydeck.sources.adapters import table

from . import render
from .registry import query

_SYMBOLS = """
with s as (select 'f' || l_partkey as path, (l_orderkey * 8 + l_linenumber)::integer as line, case when l_linestatus = 'O' then 'function' else 'struct' end as kind, 'n<' || l_suppkey || '>' as name, '(a & ' || l_linenumber || ')' as signature, l_returnflag <> 'R' as exported from lineitem),
v as (select 'f' || p_partkey as path, p_partkey as rank, p_size % 5 - 1 as level from part),
"""
_BLOCKS = (
    _SYMBOLS
    + """w as (select path, list('  ' || kind || ' ' || name order by line, kind, name, signature) as short, list('  ' || kind || ' ' || name || signature || ' @' || line order by line, kind, name, signature) as full_ from s where exported group by path),
b as (select v.path, v.rank, v.path || case when w.path is null or level < 1 then '' when level = 1 then chr(10) || array_to_string(short, chr(10)) else chr(10) || array_to_string(full_, chr(10)) end as block from v left join w using (path) where level >= 0)"""
)


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    text = lambda head, c, tail="": F.concat(F.lit(head), F.col(c).cast("string"), F.lit(tail))
    return li.select(
        text("f", "l_partkey").alias("path"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("int").alias("line"), F.when(F.col("l_linestatus") == "O", "function").otherwise("struct").alias("kind"),
        text("n<", "l_suppkey", ">").alias("name"), text("(a & ", "l_linenumber", ")").alias("signature"), (F.col("l_returnflag") != "R").alias("exported"),
    )


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.concat(F.lit("f"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_partkey").alias("rank"), (F.col("p_size") % 5 - 1).alias("level"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.file_blocks(_levels(spark, sf_dir), _symbols(spark, sf_dir))


@query("e106_file_blocks", _BLOCKS + " select * from b")
def file_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blocks(spark, sf_dir)


_XML = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(
    "e106b_xml_blocks",
    _SYMBOLS
    + f"""w as (select path, string_agg('<symbol kind="' || kind || '" line="' || line || '">' || {_XML.format("name")} || '</symbol>', '' order by line, kind, name) as inner_ from s where exported group by path)
select v.path, v.rank, '<file path="' || v.path || '">' || coalesce(inner_, '') || '</file>' as block from v left join w using (path) where level >= 0""",
)
def xml_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.xml_blocks(_levels(spark, sf_dir), _symbols(spark, sf_dir))


#: Tokens of the text that a prefix has to fit, and bytes of what is around it.
FIT, AROUND = 5000, 100


@query("e106c_fitting_prefix", _BLOCKS + f", u as (select *, sum(strlen(block) + 1) over (order by rank)::bigint as used from b) select path, rank, block, used from u where used <= {4 * FIT - AROUND}")
def fitting_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.fitting(_blocks(spark, sf_dir), FIT, AROUND)


@query(
    "e106d_with_callers",
    _BLOCKS
    + """, c as (select 'f' || l_partkey as path, 'n' || l_suppkey as name, 'c' || l_orderkey % 30 as caller_path, l_linenumber as caller_line, count(*) over (partition by l_partkey, l_suppkey) as total from lineitem),
d as (select path, name, string_agg(caller_path || ':' || caller_line, ', ' order by caller_path, caller_line) as seen, any_value(total) as total from (select distinct * from c) group by path, name),
e as (select path, string_agg('  ' || name || ' called by ' || seen || ' (' || total || ')', chr(10) order by '  ' || name || ' called by ' || seen || ' (' || total || ')') as lines from d group by path)
select b.path, b.rank, b.block || case when e.lines is null then '' else chr(10) || e.lines end as block from b left join e using (path)""",
)
def with_callers(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_partkey").cast("string")).alias("path"), F.concat(F.lit("n"), F.col("l_suppkey").cast("string")).alias("name"), F.concat(F.lit("c"), (F.col("l_orderkey") % 30).cast("string")).alias("caller_path"), F.col("l_linenumber").alias("caller_line"))
    totals = li.groupBy("path", "name").agg(F.count(F.lit(1)).alias("total"))
    return render.with_callers(_blocks(spark, sf_dir), li.join(totals, ["path", "name"]))


@query(
    "e106e_evidence",
    """
with r as (select 'f' || p_partkey as path, p_size % 3 as i, p_size % 2 as d, p_partkey % 3 as b, p_partkey % 4 as m, p_partkey % 5 = 0 as u from part)
select path, 'imported_by' as relation, 'structural' as class, i::bigint as n, 'by the names of imports' as caveat from r where i > 0
union all select path, 'depends_on', 'structural', d, 'by the names of imports' from r where d > 0
union all select path, 'boundaries', 'structural', b, 'by import prefixes' from r where b > 0
union all select path, 'mentions', 'lexical', m, 'by equal words, which may mean other things' from r where m > 0
union all select path, 'untested', 'heuristic', 1, 'no test file in the folder' from r where u""",
)
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    ranked = table(spark, sf_dir, "part").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), (size % 3).alias("imported_by"), (size % 2).alias("depends_on"), F.slice(F.array(F.lit("HTTP"), F.lit("DB")), F.lit(1), (k % 3).cast("int")).alias("boundaries"), (k % 4).alias("intra_refs"), (k % 5 == 0).alias("untested"))
    return render.evidence(ranked)


@query("e106f_json_lines", """select '{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '","p_size":' || p_size || '}' as value from part""")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.json_lines(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), ["p_partkey"])


@query(
    "e106g_source_lines",
    """
with f as (select 'f' || doc_id as path, doc_id as k, string_split(coalesce(text, ''), '. ') as ls from documents),
s as (select path, k, 1 + (k % 3)::integer as first, least(1 + k % 3 + k % 90, 1 + k % 3 + 59, len(ls))::integer as last, ls from f where k % 4 >= 2)
select path, k as rank, unnest(range(first, last + 1))::integer as line, rtrim(unnest(ls[first:last]), ' ') as text from s where last >= first""",
)
def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first lines of a declaration in every document, whose sentences are lines."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("f"), k.cast("string")).alias("path"), "doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("\r")).alias("t"))
    files = docs.select("path", F.replace("t", F.lit(". "), F.lit("\n")).alias("content"), "doc_id", F.size(F.split("t", r"\. ")).alias("n"))
    first = (1 + k % 3).cast("int")
    symbols = files.select("path", first.alias("line"), F.least(first + (k % 90).cast("int"), F.col("n")).alias("end_line"), F.lit(True).alias("exported")).where("end_line >= line")
    levels = files.select("path", k.alias("rank"), (k % 4).alias("level"))
    out = render.source_lines(levels, symbols, files.select("path", "content"))
    return out.withColumn("text", F.replace("text", F.lit("\r"), F.lit("\n")))


@query("e107_signature_fields", """
with s as (select p_partkey as k, '(' || replace(p_name, ' ', ', ') || ' string, maxWidth' || p_size || ' int)' as sig from part),
w as (select k, list_transform(string_split(regexp_replace(sig, '[(){}]', ' ', 'g'), ','), lambda f: regexp_extract(f, '([A-Za-z_][A-Za-z0-9_]*)', 1)) as ws from s),
t as (select k, list_filter(flatten(list_transform(ws, lambda n: list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(n, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[ _-]+'), lambda x: x <> ''), lambda x: lower(x)))), lambda x: length(x) > 1 and not list_contains([""" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + """], x)) as ts from w)
select k, array_to_string(ts, ' ') as tokens from t""")
def signature_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    sig = F.concat(F.lit("("), F.replace("p_name", F.lit(" "), F.lit(", ")), F.lit(" string, maxWidth"), F.col("p_size").cast("string"), F.lit(" int)"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.array_join(T.signature_tokens(sig), " ").alias("tokens"))
