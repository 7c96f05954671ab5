"""Queries of the audit brief, effect hints, parsed declarations and the code map, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrydeck.functions import parsing
from quarrydeck.operators import audit, joins, review, summaries
from quarrydeck.sources import config as settings
from quarrydeck.sources import tags as tag_files
from quarrydeck.session import dealt, shuffled
from quarrydeck.sources.adapters import table

from . import change_plan, program
from .code_map import CodeMap
from .registry import query, sql_of


def _scan(patterns: tuple[audit.Pattern, ...]) -> str:
    """Rows of a scan in SQL, without names, with the place of the pattern."""
    rows = []
    for i, p in enumerate(patterns):
        rx = program._quoted(p.regex)
        named = "" if p.name or not p.group else f" and regexp_extract(text, {rx}, {p.group}) <> '-'"
        more = " and not contains(text, 'LimitReader')" if p.kind == "unbounded-read" else ""
        rows.append(f"select path, line, '{p.kind}' as kind, {p.weight} as weight, {i} as pattern from l where regexp_matches(text, {rx}){named}{more}")
    return "(" + " union all ".join(rows) + ")"


_OF, _WHY = program._map(review.EFFECT_GROUP), program._map({k: review.LANE_REASON[review.GROUPS[g]] for k, g in review.EFFECT_GROUP.items()})
_S_OF, _S_WHY = program._map(review.SURFACE_GROUP), program._map({k: review.LANE_REASON[review.GROUPS[g]] for k, g in review.SURFACE_GROUP.items()})
_TURN, _STEP = program._map({k: 20 + i for i, k in enumerate(sorted(review.EFFECT_GROUP))}), program._map({k: 2 + i for i, k in enumerate(review.SURFACE_GROUP)})
_QUEUE = (
    program._PROGRAM
    + f""", su as {_scan(audit.SURFACE)}, ef as {_scan(audit.EFFECTS)}, ri as ({sql_of("e57_risks")}),
shown as (select {_S_OF}[kind] as grp, {_S_WHY}[kind] as reason, path, line, {{'step': {_STEP}[kind], 'key': 0::bigint, 'path': path, 'line': line}} as ord from su where {_S_OF}[kind] is not null),
items as (
  select 'ranked-risk-packets' as grp, 'highest sums of points' as reason, path, {{'step': 0, 'key': -sum(points)::bigint, 'path': path, 'line': 0}} as ord from ri group by path
  union all select {program._map(review.RISK_GROUP)}[lane], {program._map(review.LANE_REASON)}[lane], path, {{'step': 1, 'key': 0::bigint, 'path': path, 'line': 0}} from (select distinct path, lane from ri) where {program._map(review.RISK_GROUP)}[lane] is not null
  union all select grp, reason, path, ord from shown
  union all select {_OF}[kind], {_WHY}[kind], path, {{'step': {_TURN}[kind], 'key': 0::bigint, 'path': path, 'line': 0}} from (select distinct kind, path from ef)),
sc as (select path, sum(weight) + least(regexp_extract(path, '[0-9]+')::integer // 20, 10) as score from ef group by path),
fe as (select path, line, row_number() over (partition by path order by line, pattern) as pos from ef qualify pos <= {review.MOST_EFFECTS}),
near as (select * from shown union all select {_OF}[kind], {_WHY}[kind], path, fe.line, {{'step': {_TURN}[kind], 'key': -score::bigint, 'path': path, 'line': fe.pos::integer}} from (select distinct kind, path from ef) join fe using (path) join sc using (path)),
spans as (select grp, path, reason, greatest(line - {review.BEFORE}, 1) as s, least(greatest(line, 1) + {review.AFTER}, greatest(line - {review.BEFORE}, 1) + {review.LONGEST - 1}) as e, min(ord) as ord from near group by 1, 2, 3, 4, 5),
fs as (select grp, path, row_number() over (partition by grp order by min(ord), path) as pos, count(*) over (partition by grp) as n from items group by grp, path),
ss as (select *, row_number() over (partition by grp order by ord, path, s, e, reason) as pos, count(*) over (partition by grp) as n from spans),
f as (select grp, any_value(n) as n_files, list(path order by pos) filter (pos <= {review.MOST_FILES}) as files from fs group by grp),
r as (select grp, any_value(n) as n_ranges, list(path || ':' || s || '-' || e order by pos) filter (pos <= {review.MOST_RANGES}) as ranges from ss group by grp),
w as (select grp, list_sort(list(distinct reason)) as reasons from items group by grp),
q as (select {program._map({g: i for i, g in enumerate(review.GROUPS)})}[grp] as priority, grp, {program._map(review.GROUPS)}[grp] as lane, files, n_files, coalesce(n_ranges, 0) as n_ranges, ranges, reasons from f join w using (grp) left join r using (grp))"""
)


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = program._program(spark, sf_dir)
    ranked = lines.select("path", F.regexp_extract("path", "[0-9]+", 0).cast("int").alias("score")).distinct()
    return review.read_queue(program.risks(spark, sf_dir), audit.scan(lines, audit.SURFACE), audit.scan(lines, audit.EFFECTS), ranked)


@query("e80_read_queue", _QUEUE + " select priority, grp, lane, array_to_string(files, ',') as files, n_files, coalesce(array_to_string(ranges, ','), '') as ranges, n_ranges, array_to_string(reasons, '|') as reasons from q")
def read_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.transform("ranges", lambda r: F.concat(r["path"], F.lit(":"), r["start"].cast("string"), F.lit("-"), r["end"].cast("string")))
    q = _queue(spark, sf_dir)
    return q.select("priority", F.col("group").alias("grp"), "lane", F.array_join("files", ",").alias("files"), "n_files", F.coalesce(F.array_join(shown, ","), F.lit("")).alias("ranges"), "n_ranges", F.array_join("reasons", "|").alias("reasons"))


@query(
    "e81_review_lanes",
    _QUEUE
    + f""", x as (select lane, priority, unnest(files) as path, generate_subscripts(files, 1) as pos from q),
o as (select lane, path, min({{'p': priority, 'k': pos}}) as ord from x group by lane, path),
l2 as (select lane, count(*) as n_files, array_to_string(list(path order by ord)[:{review.MOST_FILES}], ',') as files from o group by lane),
y as (select lane, array_to_string(list_sort(list(distinct reason))[:{review.MOST_REASONS}], '|') as why from (select lane, unnest(reasons) as reason from q) group by lane)
select lane, files, n_files, why, coalesce({program._map(review.LANE_REASON)}[lane], 'a signal of rank or boundary') as text, coalesce({program._map(review.CAVEAT)}[lane], '') as caveat from l2 join y using (lane)""",
)
def review_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.review_lanes(_queue(spark, sf_dir)).select("lane", F.array_join("files", ",").alias("files"), "n_files", F.array_join("why", "|").alias("why"), "text", "caveat")


_NAMES = ["window.fetch", "axios", "sendMail", "fs.writeFile", "http.get", "render", "file_put_contents"]
_MARKS = ["x = fetch(a)", "mail(to)", "FILE_PUT_CONTENTS(f)", "return 1", "await Fetch(mail(x))"]


@query(
    "e82_effect_hints",
    f"""
with c as (select distinct 'f' || l_suppkey as path, {program._list(_NAMES)}[1 + l_partkey % {len(_NAMES)}] as name, l_linenumber as line from lineitem),
m as (select 'g' || p_size as path, p_partkey::integer as line, {program._list(_MARKS)}[1 + p_partkey % {len(_MARKS)}] as text from part)
select path, line, case when name in ('window.fetch', 'axios', 'http.get') then 'http' when name = 'sendMail' then 'external-message' else 'filesystem-write' end as kind, case when name in ('window.fetch', 'axios', 'http.get') then 'api-contracts' else 'data-integrity' end as lane, name as op, 'call' as source from c where name <> 'render'
union all select path, line, case when text ilike '%fetch(%' then 'http' when text ilike '%mail(%' then 'external-message' else 'filesystem-write' end, case when text ilike '%fetch(%' then 'api-contracts' else 'data-integrity' end, case when text ilike '%fetch(%' then 'fetch' when text ilike '%mail(%' then 'mail' else 'file_put_contents' end, 'line' from m where text <> 'return 1'""",
)
def effect_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("f"), F.col("l_suppkey").cast("string")).alias("path"), program._pick(_NAMES, F.col("l_partkey")).alias("name"), F.col("l_linenumber").alias("line"))
    marks = table(spark, sf_dir, "part").select(F.concat(F.lit("g"), F.col("p_size").cast("string")).alias("path"), F.col("p_partkey").cast("int").alias("line"), program._pick(_MARKS, F.col("p_partkey")).alias("text"))
    return review.effect_hints(calls, marks)


@query("e83_read_ranges", f"select l_orderkey, l_linenumber, greatest(l_partkey - {review.BEFORE}, 1)::integer as start_, least(greatest(l_suppkey, l_partkey) + {review.AFTER}, greatest(l_partkey - {review.BEFORE}, 1) + {review.LONGEST - 1})::integer as end_ from lineitem")
def read_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = review.read_range(F.col("l_partkey"), F.col("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r["start"].alias("start_"), r["end"].alias("end_"))


#: A file of Go; # stands for the number of its part, @ for the part's name. Large parts begin below 600 empty lines.
GO_FILE = "package p\n\n// Run# does @.\nfunc Run#(\n\ta int,\n\tb string,\n) (int, error) {\n\treturn 0, nil\n}\n\nconst (\n\tLow# = 1\n\thigh# = 2\n)\n\ntype Box# struct {\n\tWidth, Height int\n\tinner string\n}\n"


@query(
    "e84_go_symbols",
    """
with p as (select p_partkey as k, p_name, case when p_size > 40 then 600 else 0 end as o from part)
select 'f' || k || '.go' as path, 'Run' || k as name, 'function' as kind, '(a int, b string) (int, error)' as signature, true as exported, o + 4 as line, o + 9 as end_line, 'Run' || k || ' does ' || p_name || '.' as doc from p
union all select 'f' || k || '.go', 'Low' || k, 'constant', '', true, o + 12, o + 12, '' from p
union all select 'f' || k || '.go', 'high' || k, 'constant', '', false, o + 13, o + 13, '' from p
union all select 'f' || k || '.go', 'Box' || k, 'struct', '{Width int, Height int}', true, o + 16, o + 19, '' from p""",
)
def go_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of one file of Go for each part: parameters over lines, groups, fields, and files of any length."""
    k = F.col("p_partkey").cast("string")
    body = F.replace(F.replace(F.lit(GO_FILE), F.lit("#"), k), F.lit("@"), F.col("p_name"))
    part = dealt(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    files = part.select(F.concat(F.lit("f"), k, F.lit(".go")).alias("path"), F.lit("go").alias("language"), F.concat(F.when(F.col("p_size") > 40, F.repeat(F.lit("\n"), 600)).otherwise(""), body).alias("content"))
    return parsing.symbols(parsing.parsed_files(files)).select("path", "name", "kind", "signature", "exported", "line", "end_line", "doc")


@query(
    "e85_tags",
    """
with p as (select 'f' || p_size || '.ts' as path, p_partkey::integer as k, 'Box' || p_partkey as name from part),
m as (select 'f' || p_size || '.ts' as path, 'Box' || p_partkey as name, list(l_linenumber || 'x' || l_orderkey order by l_linenumber, l_linenumber || 'x' || l_orderkey) as parts from (select distinct l_partkey, l_linenumber, l_orderkey from lineitem) join part on l_partkey = p_partkey group by 1, 2)
select path, name, case when k % 3 = 0 then 'function' else 'class' end as kind, case when k % 3 = 0 then '(a)' when parts is null then '' else '{' || array_to_string(parts, ', ') || '}' end as signature, '' as receiver, k as line from p left join m using (path, name)""",
)
def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags of a class or function for each part, and of a member of it for each of its lines of orders."""
    own = F.col("p_partkey")
    path, name = F.concat(F.lit("f"), F.col("p_size").cast("string"), F.lit(".ts")), F.concat(F.lit("Box"), own.cast("string"))
    part = table(spark, sf_dir, "part")
    one = part.select(F.to_json(F.struct(F.lit("tag").alias("_type"), name.alias("name"), path.alias("path"), F.when(own % 3 == 0, "function").otherwise("class").alias("kind"), F.when(own % 3 == 0, "(a)").alias("signature"), own.alias("line"))).alias("value"))
    rows = table(spark, sf_dir, "lineitem").select("l_partkey", "l_linenumber", "l_orderkey").repartition("l_partkey").distinct().join(shuffled(part.select("p_partkey", "p_size")), F.col("l_partkey") == own)
    member = rows.select(F.to_json(F.struct(F.lit("tag").alias("_type"), F.concat(F.col("l_linenumber").cast("string"), F.lit("x"), F.col("l_orderkey").cast("string")).alias("name"), path.alias("path"), F.lit("field").alias("kind"), name.alias("scope"), F.lit("class").alias("scopeKind"), F.col("l_linenumber").alias("line"))).alias("value"))
    return tag_files.tag_symbols(one.union(member))


_CONFIG = 'method_blocklist: ["get*", "/^[A-Z]/"]\nexclude_paths: ["vendor/**", "dist/*"]\ninclude_paths: ["*.go", "**/*.ts", "**/*.py", "**/*.go"]\nfile_overrides: {"cmd/**": full, "src/tests/*.py": omit}\n'


@query(
    "e86_config",
    program._PATHS
    + """ select doc_id, path, regexp_matches(base, '^get|^[A-Z]') as blocked, case when starts_with(path, 'cmd/') then 2 when dir = 'src/tests' and ext = '.py' then -1 end as forced
from t where not starts_with(path, 'vendor/') and dir <> 'dist' and (ext in ('.ts', '.py') and contains(path, '/') or ext = '.go')""",
)
def config(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = settings.Config.parse(_CONFIG)
    rows = c.files(program._paths(spark, sf_dir))
    forced = F.coalesce(*[F.when(F.col("path").rlike(r["pattern"]), r["forced"]) for r in c.overrides(spark).collect()])
    return rows.select("doc_id", "path", c.blocked(F.regexp_extract("path", "[^/]*$", 0)).alias("blocked"), forced.alias("forced"))


@query(
    "e87_families",
    program._PATHS
    + """, f as (select doc_id % 40 as g, case when test then 'test' when ext in ('.md') then 'docs' when ext in ('.yaml', '.json') then 'config' when ext in ('.go', '.ts', '.py', '.rs', '.js', '.java', '.rb', '.php') then 'code' else 'other' end as family, case when contains(path, '/') then string_split(path, '/')[1] else '' end as top from t),
c as (select g, family, count(*) as n from f group by all), w as (select g, count(*) as files, min(top) as lo, max(top) as hi from f group by g),
r as (select g, files, coalesce((select family from c where c.g = w.g and 2 * n > files), 'other') as family, case when lo = hi then lo else '' end as scope from w)
select g, files, family, scope, round(least(0.95, greatest(0.3, case family when 'test' then 0.7 when 'docs' then 0.7 when 'config' then 0.6 when 'script' then 0.6 when 'code' then 0.5 else 0.4 end + case when scope <> '' then 0.05 else 0 end + case when files = 1 then 0.05 else 0 end)), 2)::double as confidence from r""",
)
def families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.polished(program._paths(spark, sf_dir).withColumn("g", F.col("doc_id") % 40), "g")


@query(
    "e88_reference_edges",
    """
with s as (select 'f' || p_size as path, p_partkey as line, 'n' || p_partkey as name from part), r as (select 'n' || l_partkey as name, 'f' || (l_suppkey % 50) as path, case when l_linenumber = 1 then l_partkey else l_linenumber end as line from lineitem)
select distinct s.path as callee_path, '' as callee_receiver, s.name as callee_name, r.path as caller_path, r.line as caller_line from s join r using (name) where s.path <> r.path or s.line <> r.line""",
)
def reference_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda head, c: F.concat(F.lit(head), c.cast("string"))
    s = table(spark, sf_dir, "part").select(text("f", F.col("p_size")).alias("path"), text("n", F.col("p_partkey")).alias("name"), F.lit("").alias("receiver"), F.col("p_partkey").alias("line"))
    r = table(spark, sf_dir, "lineitem").select(text("n", F.col("l_partkey")).alias("name"), text("f", F.col("l_suppkey") % 50).alias("path"), F.when(F.col("l_linenumber") == 1, F.col("l_partkey")).otherwise(F.col("l_linenumber").cast("long")).alias("line"))
    return tag_files.reference_edges(s, r)


_MAP = """
with p as (select p_partkey as k, p_partkey // 4 as d, p_partkey % 4 as r from part),
f as (select k, d, r, 'd' || d || '/f' || case when r = 3 then (k - 3) || '_test' else k::varchar end || '.go' as path from p)"""


def _map(spark: SparkSession, sf_dir: str, files: int | None = None) -> CodeMap:
    """A program of Go: a file for each part (or each of the first ``files``, for the bench), four in a folder (the last one tests the first), the first importing the next folder but from every third; odd files call what the file before declares."""
    k = F.col("p_partkey")
    n, d, r, text = F.floor(k / 4), F.concat(F.lit("d"), F.floor(k / 4).cast("string")), k % 4, lambda c: c.cast("string")
    path = F.concat(d, F.lit("/f"), F.when(r == 3, F.concat(text(k - 3), F.lit("_test"))).otherwise(text(k)), F.lit(".go"))
    imported = F.when((r == 0) & (n % 3 != 0), F.concat(F.lit('import "example.com/app/d'), text(n + 1), F.lit('"\n\n'))).otherwise("")
    call = F.when(k % 2 == 1, F.concat(F.lit("\tRun"), text(k - 1), F.lit("()\n"))).otherwise("")
    content = F.concat(F.lit("package "), d, F.lit("\n\n"), imported, F.lit("func Run"), text(k), F.lit("() error {\n"), call, F.lit("}\n"))
    part = table(spark, sf_dir, "part") if files is None else table(spark, sf_dir, "part").where(k < files)
    files = dealt(part.select("p_partkey"), "p_partkey").select(path.alias("path"), F.lit("go").alias("language"), content.alias("content")).withColumn("sha256", F.sha2("content", 256))
    return CodeMap.build(files, "example.com/app")


@query("e90_map_edges", _MAP + " select a.path as src, b.path as dst from f a join f b on b.d = a.d + 1 where a.r = 0 and a.d % 3 <> 0")
def map_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir).edges


@query(
    "e91_orphans",
    _MAP + " select path, 'Run' || k as name, 'function' as kind, case when r = 0 and d % 3 <> 0 then 5 else 3 end::integer as line from f where r <> 3 and not (k % 2 = 0 and exists (select 1 from f g where g.k = f.k + 1))",
)
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir).orphans()


@query(
    "e92_impact",
    _MAP
    + """, t as (select * from f where path = 'd2/f8.go'), i as (select path, d from f where r = 0 and d = 1)
select t.path, (select array_to_string(list(path order by path), ',') from i) as importers, (select array_to_string(list(path order by path), ',') from f where path = 'd2/f8_test.go') as tests, 'd1,d2' as packages from t""",
)
def impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = _map(spark, sf_dir).impact("d2/f8.go")
    return row.select("path", *[F.array_join(c, ",").alias(c) for c in ("importers", "tests", "packages")])


@query("e93_find", _MAP + " select row_number() over (order by case when k = 12 then 100 else 50 end desc, path) as pos, path, 'Run' || k as name, case when k = 12 then 100 else 50 end::integer as match from f where starts_with('Run' || k, 'Run12') and r <> 3 order by 1 limit 20")
def find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder of a name over the map's symbols but tests."""
    m = _map(spark, sf_dir)
    found = joins.find_ladder(m.symbols.where(~F.contains("path", F.lit("_test"))), "Run12")
    return joins.ranked(found, [F.desc("match"), "path"], out="pos", limit=20).select("pos", "path", "name", "match")


@query(
    "e94_context",
    _MAP + " select path, 'Run9' as name, unnest([3, 4, 5])::integer as line, unnest(['func Run9() error {', chr(9) || 'Run8()', '}']) as text from f where k = 9",
)
def context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _map(spark, sf_dir).context("Run9")


@query(
    "e95_prepared",
    """
with g as (select o_custkey % 97 as plan, count(*) as groups, count(*) filter (o_totalprice < 40000 and o_orderkey % 50 = 1 or o_orderkey % 211 = 0) as unsure from orders group by 1),
f as (select c_custkey % 97 as plan, count(*) as n from customer where c_custkey % 41 = 0 group by 1)
select plan, groups, unsure, coalesce(n, 0) as findings, case when coalesce(n, 0) > 5 or unsure > 3 then 'abort' when coalesce(n, 0) > 0 or unsure > 0 then 'needs_judgment' else 'ready' end as status from g left join f using (plan)""",
)
def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    groups = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 97).alias("plan"), F.when(k % 211 == 0, 60).otherwise(3).alias("files"), F.when(F.col("o_totalprice") < 40000, 0.5).otherwise(0.8).alias("confidence"), F.when(k % 50 == 1, 0.5).otherwise(0.6).alias("polished"))
    findings = table(spark, sf_dir, "customer").select((F.col("c_custkey") % 97).alias("plan"), F.when(F.col("c_custkey") % 41 == 0, "review").otherwise("safe").alias("action"))
    return change_plan.prepared(groups, findings, large=50)
