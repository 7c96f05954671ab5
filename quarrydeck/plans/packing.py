"""Queries of packets for many goals, of capped reports, of merged change plans and of staleness marks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrydeck.operators import audit, packets, summaries
from quarrydeck.sources import snapshots
from quarrydeck.sources.adapters import document_files, table

from . import corpus, program
from .registry import query

BUDGET, RESERVE = 900, 40
_CANDIDATES = f"""
with recursive gt as (select distinct item_id as goal, unnest(list_filter(list_transform(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9-]+'), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')), lambda x: x <> '' and not list_contains([{corpus._STOP}], x))) as term from benchmark),
d as (select {corpus._PATH} as path, source, coalesce(text, '') as text, doc_id from documents),
tk as (select path, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z0-9-]+'), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')), lambda x: x <> ''))) as term, 3 as w from d
  union all select path, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(lower(coalesce(source, '')), '[a-z0-9-]+'), lambda x: regexp_replace(x, '^-+|-+$', '', 'g')), lambda x: x <> ''))), 5 from d),
rel as (select goal, path, sum(w)::bigint as relevance from tk join gt using (term) group by 1, 2),
cost as (select path, doc_id % 100 as score, [(strlen(text) + 163) // 4, case when strlen(text) > 600 then 190 end, (strlen(path) + 123) // 4, case when text <> '' then 12 end] as costs from d),
cand as (select goal, path, costs, row_number() over (partition by goal order by relevance desc, score desc, path) as pos, count(*) over (partition by goal) as total from rel join cost using (path)),
fold(goal, pos, path, variant, cost, used, total) as (
  select goal, 0::bigint, '', 0::bigint, 0::bigint, 0::bigint, max(total) from cand group by goal
  union all
  select c.goal, c.pos, c.path, v, c.costs[v]::bigint, f.used + c.costs[v], f.total
  from (select f.*, c.path as cpath, list_position(list_transform(c.costs, lambda x: coalesce(f.used + x <= {BUDGET - RESERVE}, false)), true) as v from fold f join cand c on c.goal = f.goal and c.pos = f.pos + 1 where f.pos < {packets.TARGETS}) f
  join cand c on c.goal = f.goal and c.pos = f.pos + 1 where f.v > 0)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """goal, path, relevance, score, costs: documents as files, benchmark items as goals."""
    files = document_files(spark, sf_dir)
    goals = packets.goal_terms(table(spark, sf_dir, "benchmark"), "item_id")
    found = packets.relevance(files, goals, {"content": 3, "package": 5})
    size = F.octet_length("content")
    costs = F.array(F.floor((size + 163) / 4), F.when(size > 600, F.lit(190).cast("long")), F.floor((F.octet_length("path") + 123) / 4), F.when(size > 0, F.lit(12).cast("long")))
    number = F.regexp_extract("path", "([0-9]+)$", 1).cast("long")
    return found.join(files.select("path", (number % 100).alias("score"), costs.alias("costs")), "path")


@query("e100_packets", _CANDIDATES + f" select goal, pos::integer as pos, path, {list(packets.VARIANTS)}[variant] as variant, cost, used from fold where pos > 0")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packets.packets(_candidates(spark, sf_dir), BUDGET, RESERVE)
    return out.select("goal", F.explode("targets").alias("t")).select("goal", "t.*")


@query(
    "e100b_packet_omissions",
    _CANDIDATES
    + f""", ends as (select goal, max(pos) as shown, max(total) as total from fold group by goal)
select goal, 'targets[' || path || ']' as field, variant - 1 as shown, 4::bigint as total, 'packed as ' || {list(packets.VARIANTS)}[variant] as reason from fold where variant > 1
union all select goal, 'targets', shown, total, case when shown < {packets.TARGETS} then 'token budget' else 'target limit' end from ends where shown < total""",
)
def packet_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packets.packets(_candidates(spark, sf_dir), BUDGET, RESERVE)
    return out.select("goal", F.explode("omissions").alias("o")).select("goal", "o.*")


def _hits_sql() -> str:
    return program._FILES + f", h as ({program._scan_sql(audit.SURFACE).removeprefix(program._PROGRAM)} union all {program._scan_sql(audit.EFFECTS).removeprefix(program._PROGRAM)})"


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scan(program._masked(spark, sf_dir), audit.SURFACE + audit.EFFECTS).drop("pattern")


_CAPPED = {"files": ("path", str(packets.FILE_CAP)), "kinds": ("kind", f"case when kind = 'command' then {packets.KIND_CAPS['command']} else {packets.KIND_CAP} end"), "lanes": ("lane", str(packets.KIND_CAP))}


@query("e101_capped_report", _hits_sql() + " union all ".join(f" select '{n}' as cap, {g} as key, row_number() over (partition by {g} order by path, line, kind, name)::integer as pos, path, line, kind, lane, weight, name from h qualify pos <= {c}" for n, (g, c) in _CAPPED.items()))
def capped_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.capped(_hits(spark, sf_dir), packets.report_caps(), ["path", "line", "kind", "name"])


@query("e101b_omissions", _hits_sql() + " union all ".join(f" select '{n}' as cap, {g} as key, ({c})::bigint as shown, count(*) as total from h group by {g} having count(*) > {c}" for n, (g, c) in _CAPPED.items()))
def report_omissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.omitted(_hits(spark, sf_dir), packets.report_caps())


# A customer's orders are a plan's groups. The larger groups, then the smaller ones one by one, then the last two again and again.
_PLANS = """
with recursive g as (select o_custkey as plan, o_orderkey as id, o_orderkey % 7 + 1 as files, case when o_orderkey % 7 = 0 then ['t' || o_orderkey % 4] else ['t' || o_orderkey % 4, 't' || (o_orderkey // 4) % 4] end as tops from orders),
s as (select plan, {'nf': -files::bigint, 'id': id, 'place': tops[1], 'tops': tops, 'ids': [id]} as x from g),
p as (select plan, list(x order by x.nf, x.id) as gs from s group by plan),
ride(plan, n, out, todo) as (
  select plan, 0, list_filter(gs, lambda x: x.nf < -2), list_filter(gs, lambda x: x.nf >= -2) from p where len(gs) > 3
  union all
  select plan, n + 1, case when slot is null or slot = 0 then list_append(out, todo[1]) else list_transform(out, lambda x, i: case when i = slot then {'nf': x.nf + todo[1].nf, 'id': x.id, 'place': x.place, 'tops': x.tops, 'ids': list_concat(x.ids, todo[1].ids)} else x end) end, todo[2:]
  from (select *, list_position(list_transform(out, lambda x: list_contains(todo[1].tops, x.place)), true) as slot from ride where len(todo) > 0)),
m(plan, gs) as (
  select plan, list_sort(out) from ride where len(todo) = 0
  union all
  select plan, list_sort(list_append(gs[1:len(gs) - 2], {'nf': gs[-2].nf + gs[-1].nf, 'id': gs[-2].id, 'place': gs[-2].place, 'tops': gs[-2].tops, 'ids': list_concat(gs[-2].ids, gs[-1].ids)})) from m where len(gs) > 3),
done as (select plan, unnest(gs) as x from m where len(gs) <= 3 union all select plan, unnest(gs) from p where len(gs) <= 3)
select plan, unnest(x.ids) as id, x.id as into_, -x.nf as files from done"""


@query("e73b_merged_plans", _PLANS)
def merged_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    place = lambda c: F.concat(F.lit("t"), c.cast("string"))
    first, second = place(i % 4), place(F.floor(i / 4) % 4)
    groups = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("plan"), i.alias("id"), (i % 7 + 1).alias("files"), F.when(i % 7 == 0, F.array(first)).otherwise(F.array(first, second)).alias("tops"))
    return summaries.merged_plans(groups).withColumnRenamed("into", "into_")


# Documents are files; every third moved in time, some of these in content too, and some came and went.
_STATS = f"""
with d as (select doc_id, {corpus._PATH} as path, coalesce(text, '') as text from documents),
a as (select path, strlen(text) as size, 0 as mtime, sha256(text) as sha256 from d where doc_id % 11 <> 0),
b as (select path, strlen(text || case when doc_id % 6 = 0 then '!' else '' end) as size, (doc_id % 3 = 0)::int as mtime, sha256(text || case when doc_id % 6 = 0 then '!' else '' end) as sha256 from d where doc_id % 13 <> 0)"""


def _stats(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = document_files(spark, sf_dir).withColumn("i", F.regexp_extract("path", "([0-9]+)$", 1).cast("long"))
    old = d.where("i % 11 <> 0").select("path", F.octet_length("content").cast("long").alias("size"), F.lit(0).alias("mtime"), F.sha2(F.col("content").cast("binary"), 256).alias("sha256"))
    text = F.concat("content", F.when(F.col("i") % 6 == 0, "!").otherwise(""))
    now = d.where("i % 13 <> 0").select("path", F.octet_length(text).cast("long").alias("size"), (F.col("i") % 3 == 0).cast("int").alias("mtime"), text.alias("content"))
    return old, now


@query("e102_staleness", _STATS + " select path, case when a.path is null then 'added' when b.path is null then 'deleted' when a.sha256 = b.sha256 then 'fresh' else 'modified' end as status, b.size, b.sha256 from a full outer join b using (path)")
def staleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, now = _stats(spark, sf_dir)
    return snapshots.refreshed(old, now).select("path", "status", "size", "sha256")


_LANE = "sum(('0x' || substr(sha256(path || chr(0) || sha256), {at}, 15))::bigint::hugeint)::varchar"


@query("e102b_folder_marks", _STATS + f" select regexp_replace(path, '/[^/]*$', '') as folder, count(*) as n, {', '.join(_LANE.format(at=1 + 15 * k) + f' as m{k}' for k in range(4))} from b group by 1")
def folder_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The marks of the new state, from those of the old one and of the rows that changed alone."""
    old, now = _stats(spark, sf_dir)
    changes = snapshots.refreshed(old, now).where("status <> 'fresh'")
    gone = old.join(changes.where("status <> 'added'").select("path"), "path", "left_semi")
    marks = snapshots.moved_marks(snapshots.folder_marks(old), snapshots.folder_marks(gone), snapshots.folder_marks(changes.where("status <> 'deleted'")))
    return marks.select("folder", "n", *[F.col(f"m{k}").cast("string").alias(f"m{k}") for k in range(4)])
