"""Queries of streamed requests, of the map's features, of parse coverage and of reports through the map, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrydeck.functions import classify, parsing
from quarrydeck.session import checkpoint_dir
from quarrydeck.sources.adapters import table
from quarrydeck.streaming import requests

from . import program, reviews
from .registry import query

# Parts are symbols in files by their size; orders are requests, the second half after the map's lines moved by 100.
_REQUESTS = """
with s as (select 'f' || p_size || '.go' as path, case when p_partkey % 2 = 0 then 'Get' else 'get' end || p_partkey % 700 as name, p_partkey as line from part),
half as (select max(o_orderkey) // 2 as h from orders),
q as (select o_orderkey as id, o_orderkey % 6 as kind, o_custkey as c, case when o_orderkey <= h then 1 else 2 end as version from orders, half),
f as (select q.id, q.version, s.path, s.line + case when q.version = 2 then 100 else 0 end as line, row_number() over (partition by q.id order by (s.name <> 'Get' || c % 800)::int, s.path, s.line, s.name) as pos, count(*) over (partition by q.id) as total
  from q join s on lower(s.name) = lower('Get' || c % 800) where kind in (0, 1)),
e as (select q.id, q.version, sum(p_size) as score from q join part on 'f' || p_size || '.go' = 'f' || c % 60 || '.go' where kind = 2 group by all),
n as (select (select count(distinct path) from s) as files, (select count(*) from s) as symbols)
select id::varchar as id, 'symbol/find' as method, q.version::bigint as version, null::integer as code, coalesce(f.total, 0)::varchar as total, f.path || ':' || f.line as first from q left join f using (id) where kind = 0 and coalesce(pos, 1) = 1
union all select id::varchar, 'file/context', q.version, case when f.path is null then -32000 end, f.total::varchar, f.path || ':' || f.line from q left join f using (id) where kind = 1 and coalesce(pos, 1) = 1
union all select id::varchar, 'file/explain', q.version, case when e.score is null then -32000 end, e.score::varchar, null from q left join e using (id) where kind = 2
union all select id::varchar, 'map/status', version, null, files || ' ' || symbols, null from q, n where kind = 3
union all select id::varchar, 'map/forget', version, -32601, null, null from q where kind = 4
union all select null, null, version, -32700, null, null from q where kind = 5"""


def _request(kind, c):
    ask = lambda method, name, value: F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.lit(method).alias("method"), F.struct(value.alias(name)).alias("params")))
    named = F.concat(F.lit("Get"), (c % 800).cast("string"))
    path = F.concat(F.lit("f"), (c % 60).cast("string"), F.lit(".go"))
    return F.when(kind == 0, ask("symbol/find", "query", named)).when(kind == 1, ask("file/context", "query", named)).when(kind == 2, ask("file/explain", "path", path)).when(kind == 3, ask("map/status", "query", F.lit(""))).when(kind == 4, ask("map/forget", "query", named)).otherwise("{not json")


@query("e103_requests", _REQUESTS)
def answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered in batches from a snapshot that is replaced halfway."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/requests-{uuid.uuid4().hex}"
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    path = F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit(".go")).alias("path")
    symbols = part.select(path, F.concat(F.when(k % 2 == 0, "Get").otherwise("get"), (k % 700).cast("string")).alias("name"), F.lit("function").alias("kind"), k.cast("int").alias("line"), k.cast("int").alias("end_line"))
    components = part.select(path, F.concat(F.lit("part"), k.cast("string")).alias("component"), F.col("p_size").cast("long").alias("value"))
    files = part.select(path).distinct().withColumn("content", F.repeat(F.lit("line\n"), 10))
    orders = table(spark, sf_dir, "orders")
    half = orders.agg(F.floor(F.max("o_orderkey") / 2)).first()[0] or 0
    lines = orders.select("o_orderkey", _request(F.col("o_orderkey") % 6, F.col("o_custkey")).alias("value"))
    for number, mine in ((1, lines.where(F.col("o_orderkey") <= half)), (2, lines.where(F.col("o_orderkey") > half))):
        moved = symbols.withColumn("line", F.col("line") + 100 * (number - 1)).withColumn("end_line", F.col("line"))
        requests.publish(spark, {"symbols": moved, "components": components, "files": files}, f"{folder}/map", number)
        mine.select("value").write.mode("append").text(f"{folder}/inbox")
        requests.serve(spark, f"{folder}/inbox", f"{folder}/map", f"{folder}/out", f"{folder}/state", results=f"{folder}/results").awaitTermination()
    got, results = spark.read.parquet(f"{folder}/out"), spark.read.parquet(f"{folder}/results")
    field = lambda p: F.get_json_object("result", p)
    status = F.concat_ws(" ", field("$.files"), field("$.symbols"))
    total = F.when(F.col("method") == "map/status", status).otherwise(F.coalesce(field("$.total"), field("$.score")))
    first = F.concat_ws(":", F.coalesce(field("$.matches[0].path"), field("$.path")), F.coalesce(field("$.matches[0].line"), field("$.line")))
    told = results.select(F.col("batch").alias("_b"), F.col("method").alias("_m"), F.col("asked").alias("_a"), total.alias("total"), F.nullif(first, F.lit("")).alias("first"))
    same = F.col("code").isNull() & (F.col("batch") == F.col("_b")) & (F.col("method") == F.col("_m")) & F.col("asked").eqNullSafe(F.col("_a"))
    return got.join(told, same, "left").select("id", "method", "version", "code", "total", "first")


@query(
    "e104_map_features",
    reviews._MAP
    + """, n as (select d, count(*) as files, bool_or(r = 3) as tested from f group by d)
select path, (d >= 1 and (d - 1) % 3 <> 0)::int::bigint as imported_by, case when r = 0 and d % 3 <> 0 then coalesce((select files from n where n.d = f.d + 1), 0) else 0 end::bigint as depends_on,
  not n.tested as untested, not (d >= 1 and (d - 1) % 3 <> 0) as all_dead, case when d >= 1 and (d - 1) % 3 = 1 then 5 when d >= 2 and (d - 1) % 3 = 2 then 10 else 0 end::bigint as transitive from f join n using (d)""",
)
def map_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan-in, fan-out, tests by package, dead files and transitive dependents of every file of a map."""
    return reviews._map(spark, sf_dir).ranked.select("path", F.col("imported_by").cast("long").alias("imported_by"), F.col("depends_on").cast("long").alias("depends_on"), "untested", "all_dead", F.col("transitive").cast("long").alias("transitive"))


_PARSED = program._list(sorted(parsing.LANGUAGES))


@query(
    "e105_coverage",
    program._PATHS
    + f""", g as (select coalesce({program._map(classify.LANGUAGES)}[ext], '') as language from t)
select language, count(*) as files, case when list_contains({_PARSED}, language) then count(*) else 0 end::bigint as parsed, case when list_contains({_PARSED}, language) then 0 else count(*) end::bigint as failed from g group by language""",
)
def parse_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many files of each language were parsed: documents as files of a program, with their whole texts."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("content"))
    files = program._paths(spark, sf_dir).join(texts, "doc_id").select(F.concat_ws("#", "path", F.col("doc_id").cast("string")).alias("path"), classify.language(F.col("path")).alias("language"), "content")
    return parsing.coverage(files, parsing.parsed_files(files)).select("language", "files", "parsed", "failed")
