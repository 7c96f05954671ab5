"""Queries that put the tables, seen as a program's files, names, lines, listings and calls, through the operators of the code map, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrydeck.functions import classify, text as T
from quarrydeck.operators import audit, budget, callers, joins, masks, summaries
from quarrydeck.session import cut, shuffled
from quarrydeck.sources import history
from quarrydeck.sources.adapters import table

from .registry import query, sql_of

FOLDERS = ["cmd/app", "internal/store", "pkg/api/v1", "vendor/lib", "node_modules/y", "src/tests", ".", "dist/x"]
BASES = ["main", "store", "user_test", "index", "types", "Handler", "a.min", "test_util", "README", "go", "FooTest", "app-0123abcd9-x", "x.spec"]
ENDINGS = [".go", ".ts", ".py", ".rs", ".md", ".json", ".js", ".yaml", ".java", ".mod", ".rb", ".log", ".php"]


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(xs: list[str]) -> str:
    return "[" + ", ".join(map(_quoted, xs)) + "]"


def _map(table_: dict) -> str:
    return "map {" + ", ".join(f"{_quoted(k)}: {_quoted(v) if isinstance(v, str) else v}" for k, v in table_.items()) + "}"


_PATHS = f"""
with d as (select doc_id, {_list(FOLDERS)}[1 + doc_id % {len(FOLDERS)}] as folder, {_list(BASES)}[1 + (doc_id // {len(FOLDERS)}) % {len(BASES)}] || {_list(ENDINGS)}[1 + (doc_id // 3) % {len(ENDINGS)}] as base from documents),
p as (select doc_id, case when folder = '.' then base else folder || '/' || base end as path from d),
b as (select *, regexp_extract(path, '[^/]*$') as base, case when contains(path, '/') then regexp_replace(path, '/[^/]*$', '') else '.' end as dir from p),
e as (select *, regexp_extract(base, '([.][^.]*)$', 1) as ext, regexp_replace(base, '(.)[.][^.]*$', '\\1') as stem, length(path) - length(replace(path, '/', '')) as depth from b),
t as (select *, case ext when '.go' then ends_with(path, '_test.go') when '.py' then regexp_matches(base, '^test_|_test[.]py$') when '.rs' then contains(path, '/tests/') or ends_with(base, '_test.rs')
  when '.java' then regexp_matches(base, 'Tests?[.]java$') when '.rb' then regexp_matches(base, '_(test|spec)[.]rb$') when '.php' then ends_with(base, 'Test.php')
  when '.ts' then regexp_matches(base, '[.](test|spec)[.]tsx?$') when '.js' then regexp_matches(base, '[.](test|spec)[.]jsx?$') else false end as test,
  case when base = 'main.go' then 50 when base in ('main.ts', 'index.ts', 'index.js', 'main.py', 'main.rs') then 30 else 0 end as entry from e)"""


def _pick(xs: list[str], c: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in xs]), (1 + c % len(xs)).cast("int"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, path: every document as a file of a program."""
    i = F.col("doc_id")
    folder = _pick(FOLDERS, i)
    base = F.concat(_pick(BASES, F.floor(i / len(FOLDERS))), _pick(ENDINGS, F.floor(i / 3)))
    return table(spark, sf_dir, "documents").select("doc_id", F.when(folder == ".", base).otherwise(F.concat(folder, F.lit("/"), base)).alias("path"))


@query(
    "e50_paths",
    _PATHS
    + f"""
select doc_id, path, dir, base, stem, ext, depth::integer as depth, coalesce({_map(classify.LANGUAGES)}[ext], '') as language, list_has_any(string_split(dir, '/'), {_list(classify.SKIP_DIRS)}) as skipped,
  regexp_matches(base, '[.]min[.](js|css)$|[.]bundle[.]js$|[.]chunk[.](js|css)$|_compiled[.]js$|[.]generated[.]|[.-][0-9a-f]{{8,}}[.-]') as artifact, test, entry, least(0, 2 - depth)::integer as penalty
from t""",
)
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return _paths(spark, sf_dir).select(
        "doc_id", "path", T.dirname(p).alias("dir"), T.basename(p).alias("base"), T.stem(p).alias("stem"), T.extension(p).alias("ext"), T.depth(p).alias("depth"), classify.language(p).alias("language"),
        classify.in_skip_dir(p).alias("skipped"), classify.is_build_artifact(p).alias("artifact"), classify.is_test_file(p).alias("test"), classify.entry_boost(p).alias("entry"), classify.depth_penalty(T.depth(p)).alias("penalty"),
    )


@query(
    "e51_change_types",
    _PATHS
    + """
select doc_id, case when regexp_matches(base, '(?i)^(audit|review|plan|notes|scratch)[.]md$|(?i)-output[.]md$') or regexp_matches(path, '[.](log|tmp|bak|swp)$|^(dist|build|coverage|node_modules)/') then 'artifact'
  when base in ('go.mod', 'go.sum', 'package.json', 'package-lock.json', 'Cargo.toml', 'Cargo.lock') then 'deps' when test then 'test' when ends_with(path, '.md') then 'docs'
  when base in ('Makefile', 'Dockerfile') or regexp_matches(path, '^([.]github|ci)/') or starts_with(base, '.env') or ext in ('.md', '.yaml', '.yml', '.json', '.toml', '.cfg', '.ini', '.conf') then 'chore' else 'feat' end as type
from t""",
)
def change_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("doc_id", classify.change_type(F.col("path")).alias("type"))


@query(
    "e52_weights",
    f"""
with k as (select p_partkey, p_size, {_list([*classify.DISPLAY_WEIGHT, "other"])}[1 + p_partkey % {len(classify.DISPLAY_WEIGHT) + 1}] as kind, p_size > 5 as exported, 'a' || case when p_size % 2 = 0 then '_test.go' else '.go' end as path, case p_size % 3 when 0 then 'Test' when 1 then 'Fuzz' else 'Run' end || p_type as name from part)
select p_partkey, kind, case when not exported then 1 else coalesce({_map(classify.DISPLAY_WEIGHT)}[kind], 2) end::integer as display, coalesce({_map(classify.SCORE_WEIGHT)}[kind], 1)::integer as score,
  ends_with(path, '_test.go') and regexp_matches(name, '^(Test|Benchmark|Fuzz)') as test, case when p_size >= 16 then 'high' when p_size >= 8 then 'medium' else 'low' end as tier from k""",
)
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    name = F.concat(F.when(size % 3 == 0, "Test").when(size % 3 == 1, "Fuzz").otherwise("Run"), F.col("p_type"))
    path = F.concat(F.lit("a"), F.when(size % 2 == 0, "_test.go").otherwise(".go"))
    k = table(spark, sf_dir, "part").withColumn("kind", _pick([*classify.DISPLAY_WEIGHT, "other"], F.col("p_partkey")))
    return k.select("p_partkey", "kind", classify.display_weight(F.col("kind"), size > 5).alias("display"), classify.score_weight(F.col("kind")).alias("score"), classify.is_test_symbol(path, name).alias("test"), classify.relevance_tier(size).alias("tier"))


@query(
    "e53_names_and_docs",
    """
with b as (select item_id, text, regexp_extract(text, '^[^ ]*') as name from benchmark),
r as (select *, case when starts_with(text, name || ' ') then substr(text, length(name) + 2) else text end as rest from b),
s as (select *, trim(regexp_extract(rest, '^([^.\\n]*)', 1)) as first from r),
c as (select *, case when length(first) <= 60 then first when regexp_extract(left(first, 60), '^(.*[^ \\t\\n\\f\\r])[ \\t\\n\\f\\r]+[^ \\t\\n\\f\\r]*$', 1) <> '' then regexp_extract(left(first, 60), '^(.*[^ \\t\\n\\f\\r])[ \\t\\n\\f\\r]+[^ \\t\\n\\f\\r]*$', 1) else left(first, 60) end as short from s),
n as (select *, 'get' || upper(left(name, 3)) || 'Of_HTTPServer' || item_id as symbol from c)
select item_id, case when strlen(short) < 5 then '' else short end as doc,
  array_to_string(list_transform(list_filter(string_split_regex(regexp_replace(regexp_replace(symbol, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[ _-]+'), lambda x: x <> ''), lambda x: lower(x)), ' ') as parts from n""",
)
def names_and_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("name", F.regexp_extract("text", "^[^ ]*", 0))
    symbol = F.concat(F.lit("get"), T.upper(F.substring("name", 1, 3)), F.lit("Of_HTTPServer"), F.col("item_id").cast("string"))
    return b.select("item_id", T.first_sentence(F.col("text"), F.col("name")).alias("doc"), F.array_join(T.camel_tokens(symbol), " ").alias("parts"))


#: Lines of a program; # stands for the number of the part that a line is made for.
LINES = [
    'Use:   "show#",', 'cmd.Flags().StringVar("f#", "x")', 'flag.Bool("b#", true)', 'v := os.Getenv("ENV_#")', 'A int `yaml:"a#,omitempty"`', 'B int `json:"b#"`', 'http.HandleFunc("/p#", s.show#)', 'r.Get("/q#", func(w R) {})',
    'mux.HandleFunc("GET /r#", show#)', 'C int `db:"c#"`', "fmt.Fprintf(os.Stderr, x)", 'os.WriteFile("f#", b)', 'os.ReadFile("g#")', 'exec.Command("ls")', "os.Exit(#)", "tx.Commit()", "json.Marshal(x#)", 'token = "abcdef#ghijkl"',
    "h := sha256.New()", "t := time.Now()", "rand.Int()", "ctx := context.Background()", "go func() {", "io.ReadAll(r)", "io.ReadAll(io.LimitReader(r, #))", "return #", 'app.Post("/s#", s.add#)',
]
_PROGRAM = f"with l as (select 'f_' || p_size || '.go' as path, p_partkey::integer as line, replace({_list(LINES)}[1 + p_partkey % {len(LINES)}], '#', p_size::varchar) as text from part)"


def _program(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.replace(_pick(LINES, F.col("p_partkey")), F.lit("#"), F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("f_"), F.col("p_size").cast("string"), F.lit(".go")).alias("path"), F.col("p_partkey").cast("int").alias("line"), text.alias("text"))


def _scan_sql(patterns: tuple[audit.Pattern, ...]) -> str:
    def one(p: audit.Pattern) -> str:
        rx = _quoted(p.regex)
        name = _quoted(p.name) if p.name else f"regexp_replace(regexp_extract(text, {rx}, {p.group}), '[(]$', '')"
        more = " and not contains(text, 'LimitReader')" if p.kind == "unbounded-read" else ""
        return f"select path, line, {_quoted(p.kind)} as kind, {_quoted(p.lane)} as lane, {p.weight} as weight, {name} as name from l where regexp_matches(text, {rx}){more}"

    return _PROGRAM + " select * from (" + " union all ".join(map(one, patterns)) + ") where name <> '-'"


@query("e54_surface", _scan_sql(audit.SURFACE))
def surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scan(_program(spark, sf_dir), audit.SURFACE).drop("pattern")


@query("e55_effects", _scan_sql(audit.EFFECTS))
def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scan(_program(spark, sf_dir), audit.EFFECTS).drop("pattern")


_NET, _CHI = _quoted(audit.ROUTES["net/http"]), _quoted(audit.ROUTES["chi"])


@query(
    "e56_routes",
    _PROGRAM
    + f""", a as (select path, line, regexp_extract(text, {_NET}, 1) as w, regexp_extract(text, {_NET}, 2) as h from l where regexp_matches(text, {_NET})),
c as (select path, line, regexp_extract(text, {_CHI}, 1) as m, regexp_extract(text, {_CHI}, 2) as p, regexp_extract(text, {_CHI}, 3) as h from l where regexp_matches(text, {_CHI}))
select path, line, 'net/http' as framework, case when contains(w, ' ') then string_split(w, ' ')[1] else 'ANY' end as method, case when contains(w, ' ') then trim(regexp_replace(w, '^[^ ]* ', '')) else w end as pattern, case when h = 'func' then '<inline>' else h end as handler from a
union all select path, line, 'chi', upper(m), p, case when h = 'func' then '<inline>' else h end from c""",
)
def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.routes(_program(spark, sf_dir))


LABELS = ["HTTP", "Postgres", "Shell", "Crypto", "Other"]
_POINTS = {**{k: v[0] for k, v in audit.RISK_BY_BOUNDARY.items()}}
_LANES = {**{k: v[1] for k, v in audit.RISK_BY_BOUNDARY.items()}}


@query(
    "e57_risks",
    f"""
with r as (select case p_partkey % 4 when 0 then 'cmd/a' when 1 then 'b/main' when 2 then 'c/d_test' else 'e/f' end || p_partkey || '.go' as path, p_size % 9 as imported_by, p_size % 6 as depends_on, p_size % 3 = 0 as untested, {_list(LABELS)}[1 + p_partkey % 5] as label, p_size * 3 as longest, p_size % 11 = 0 as dead, case when p_size % 2 = 0 then 'go_ast' else 'regex' end as parse from part),
s as (select * from r where not ends_with(path, '_test.go'))
select path, 'entry' as rule, 'cli-ux' as lane, 20 as points from s where starts_with(path, 'cmd/') union all select path, 'imported', 'architecture', 15 from s where imported_by >= 5
union all select path, 'depends', 'coupling', 10 from s where depends_on >= 4 union all select path, 'untested', 'test-risk', 10 from s where untested
union all select path, 'large', 'large-functions', 8 from s where longest >= 80 union all select path, 'dead', 'dead-code', 8 from s where dead
union all select path, 'parse', 'parse-fidelity', 6 from s where parse <> 'go_ast'
union all select path, 'boundary:' || label, coalesce({_map(_LANES)}[label], 'best-practices'), coalesce({_map(_POINTS)}[label], 8) from s""",
)
def risks(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, size = F.col("p_partkey"), F.col("p_size")
    head = F.when(i % 4 == 0, "cmd/a").when(i % 4 == 1, "b/main").when(i % 4 == 2, "c/d_test").otherwise("e/f")
    rows = table(spark, sf_dir, "part").select(
        F.concat(head, i.cast("string"), F.lit(".go")).alias("path"), (size % 9).alias("imported_by"), (size % 6).alias("depends_on"), (size % 3 == 0).alias("untested"), F.array(_pick(LABELS, i)).alias("boundaries"),
        (size * 3).alias("longest"), (size % 11 == 0).alias("all_dead"), F.when(size % 2 == 0, "go_ast").otherwise("regex").alias("parse_method"),
    )
    return audit.risks(rows)


@query("e58_numstat", "select 'p' || l_partkey as path, sum(l_linenumber)::bigint as added, sum(case when l_returnflag = 'N' then 0 else l_suppkey end)::bigint as removed from lineitem group by 1")
def numstat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line counts from the listings of all orders; a third of the lines come as renames."""
    removed = F.when(F.col("l_returnflag") == "N", "-").otherwise(F.col("l_suppkey").cast("string"))
    path = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    shown = F.when(F.col("l_linenumber") % 3 == 0, F.concat(F.lit("old => "), path)).otherwise(path)
    line = F.concat_ws("\t", F.col("l_linenumber").cast("string"), removed, shown)
    return history.numstat(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("raw")))


@query(
    "e59_name_status",
    """
select 'p' || l_partkey as path, case l_returnflag when 'A' then 'added' when 'N' then 'modified' else 'deleted' end as status from lineitem
union select 'n' || l_partkey, 'added' from lineitem where l_returnflag = 'R'""",
)
def name_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("p"), F.col("l_partkey").cast("string"))
    flag = F.col("l_returnflag")
    line = F.when(flag == "A", F.concat_ws("\t", F.lit("A"), path)).when(flag == "N", F.concat_ws("\t", F.lit("M"), path)).otherwise(F.concat_ws("\t", F.lit("R100"), path, F.concat(F.lit("n"), F.col("l_partkey").cast("string"))))
    return history.name_status(table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(line), "\n").alias("raw")))


@query("e60_change_sets", "select 'o' || l_orderkey as set, 'p' || l_partkey as item from lineitem")
def change_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("p"), F.col("l_partkey").cast("string"))), "\n").alias("items"))
    return history.change_sets(one.select(F.concat(F.lit("commit o"), F.col("l_orderkey").cast("string"), F.lit("\n"), F.col("items"), F.lit("\n\n")).alias("raw")))


@query(
    "e61_status_listing",
    """
select case o_orderkey % 4 when 3 then '' else 'dir ' end || 'f' || o_orderkey as path, case when o_orderkey % 4 = 1 then 'old' || o_orderkey else '' end as old_path,
  case o_orderkey % 4 when 0 then 'M' when 1 then 'R' when 2 then '?' else '!' end as index_status, case o_orderkey % 4 when 0 then '.' when 1 then '.' when 2 then '?' else '!' end as status from orders""",
)
def status_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of status listings, one listing for each customer."""
    key = F.col("o_orderkey").cast("string")
    name, turn = F.concat(F.lit("dir f"), key), F.col("o_orderkey") % 4
    entry = F.when(turn == 0, F.concat(F.lit("1 M. N... 100644 100644 100644 aa bb "), name)).when(turn == 1, F.concat(F.lit("2 R. N... 100644 100644 100644 aa bb R100 "), name, F.lit("\0old"), key)).when(turn == 2, F.concat(F.lit("? "), name)).otherwise(F.concat(F.lit("! f"), key))
    raw = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.concat(F.lit("# branch.head main\0"), F.array_join(F.collect_list(entry), "\0"), F.lit("\0")).alias("raw"))
    return history.porcelain(raw)


RULES = ["AGENTS.md", "internal/AGENTS.md", "pkg/api/RULES.md", "src/tests/x.md", "vendor/lib/deep/x.md"]
_RULES = "(select r as rule, case when contains(r, '/') then regexp_replace(r, '/[^/]*$', '') else '.' end as folder from (select unnest(" + _list(RULES) + ") as r))"


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(r,) for r in RULES], "rule string")


@query("e62_applicable_rules", _PATHS + f" select distinct path, rule from t join {_RULES} r on r.folder = '.' or r.folder = dir or starts_with(dir, r.folder || '/')")
def applicable_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callers.applicable_rules(_paths(spark, sf_dir), _rules(spark))


@query("e63_nearest_manifest", _PATHS + f" select path, arg_max(rule, case when r.folder = '.' then 0 else length(r.folder) end) as manifest from t join {_RULES} r on r.folder = '.' or r.folder = dir or starts_with(dir, r.folder || '/') group by path")
def nearest_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callers.nearest_manifest(_paths(spark, sf_dir), _rules(spark))


@query(
    "e64_implementations",
    """
with m as (select distinct l_suppkey as type, p_type || p_size as method from lineitem join part on l_partkey = p_partkey),
r as (select distinct p_brand || '/' || p_name as interface, p_type || p_size as method from part),
n as (select interface, count(*) as need from r group by 1)
select 's' || type as type, interface from m join r using (method) join n using (interface) group by type, interface, need having count(*) = need""",
)
def implementations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_type", F.col("p_size").cast("string")).alias("method"), F.concat("p_brand", F.lit("/"), "p_name").alias("interface"))
    li = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("type"), F.col("l_partkey").alias("p_partkey"))
    return callers.implementations(li.join(shuffled(p.select("p_partkey", "method")), "p_partkey").select("type", "method"), p.select("interface", "method"))


_CALLS = """
with s as (select distinct p_brand as path, p_name as name, case when p_size % 2 = 0 then p_type else '' end as receiver from part),
c as (select distinct p_brand as path, p_name as name, case when l_linenumber % 2 = 0 and p_size % 2 = 0 then p_type else '' end as receiver, 'order' || l_orderkey % 50 || case when l_suppkey % 7 = 0 then '_test.go' else '.go' end as caller_path, l_quantity::integer as caller_line from lineitem join part on l_partkey = p_partkey),
k as (select * from c where not ends_with(caller_path, '_test.go')),
x as (select s.path, s.name, s.receiver, caller_path, caller_line from s join k using (path, name, receiver)),
b as (select s.path, s.name, s.receiver, k.caller_path, k.caller_line from s join k on k.path = s.path and k.name = s.name and k.receiver = ''
  where s.receiver <> '' and not exists (select 1 from x where x.path = s.path and x.name = s.name and x.receiver = s.receiver)),
a as (select * from x union all select * from b)"""


def _calls(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Symbols of part, and every line item as a call of one."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("").alias("receiver"))
    li = table(spark, sf_dir, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey"))
    by = F.concat(F.lit("order"), (F.col("l_orderkey") % 50).cast("string"), F.when(F.col("l_suppkey") % 7 == 0, "_test.go").otherwise(".go"))
    receiver = F.when(F.col("l_linenumber") % 2 == 0, F.col("receiver")).otherwise("")
    calls = li.select(F.col("path").alias("callee_path"), F.col("name").alias("callee_name"), receiver.alias("callee_receiver"), by.alias("caller_path"), F.col("l_quantity").cast("int").alias("caller_line"))
    return p.drop("p_partkey"), calls


@query("e65_callers", _CALLS + " select path, name, receiver, caller_path, caller_line, total from (select *, row_number() over (partition by path, name, receiver order by caller_path, caller_line) as r, count(*) over (partition by path, name, receiver) as total from a) where r <= 10")
def callers_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, calls = _calls(spark, sf_dir)
    return callers.callers_of(symbols, calls).select("path", "name", "receiver", "caller_path", "caller_line", "total")


@query("e66_caller_counts", _CALLS + " select path, count(distinct caller_path) as callers, least(2 * count(distinct caller_path), 30)::bigint as bonus from c group by 1")
def caller_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return callers.caller_bonus(_calls(spark, sf_dir)[1])


@query(
    "e67_reference_bonus",
    """
with w as (select distinct doc_id as path, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_]+')) as word from documents),
n as (select distinct 1000000 + item_id as path, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as name from benchmark),
f as (select name, count(distinct path) as files from n where strlen(name) >= 4 group by 1), t as (select floor(count(distinct path) * 0.01) as most from w where strlen(word) >= 4),
r as (select n.path, name, count(distinct w.path) as refs from n join f using (name) join w on w.word = n.name, t where not (most >= 2 and files > most) group by 1, 2)
select path, least(2 * sum(refs), 24)::bigint as bonus from r group by 1""",
)
def reference_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.explode(T.identifiers(F.coalesce("text", F.lit("")))).alias("word"))
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") + 1000000).alias("path"), F.explode(T.identifiers(F.col("text"))).alias("name"))
    return joins.reference_bonus(joins.references(d, b, 0.01))


@query(
    "e68_costs",
    """
select p_brand as path, sum(8 + strlen(p_name) + strlen(p_type) + case when p_partkey % 3 = 0 then strlen(p_type) + 4 else 0 end + case when p_size % 2 = 0 then strlen(p_name) + 8 else 0 end)::bigint as cost, sum(8 + strlen(p_name))::bigint as compact_cost
from part where p_size > 5 group by 1""",
)
def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "method").otherwise("function")
    symbols = p.select(F.col("p_brand").alias("path"), F.col("p_name").alias("name"), F.col("p_type").alias("signature"), F.col("p_type").alias("receiver"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).alias("doc"), kind.alias("kind"), (F.col("p_size") > 5).alias("exported"))
    return budget.enriched_cost(symbols)


@query(
    "e69_levels",
    """
with recursive f as (select row_number() over (order by s_acctbal desc, s_suppkey) as rank, s_suppkey as path, 20 + s_suppkey % 7 as header, s_suppkey * 31 % 90 as summary, 2 * (s_suppkey * 31 % 90) + s_suppkey % 50 as cost from supplier),
h as (select *, sum(header) over (order by rank rows unbounded preceding) <= 1792 as shown from f),
i as (select *, row_number() over (order by rank) as n from h where shown and summary > 0), b as (select 2560 - coalesce(sum(header), 0) as room from h where shown),
g as (select n, path, rank, summary, cost, summary <= room as got, case when summary <= room then room - summary else room end as room from i, b where n = 1
  union all select i.n, i.path, i.rank, i.summary, i.cost, i.summary <= g.room, case when i.summary <= g.room then g.room - i.summary else g.room end from g join i on i.n = g.n + 1),
j as (select *, row_number() over (order by rank) as m from g where got), q as (select coalesce(min(room), (select room from b)) as room from g),
k as (select m, path, rank, cost - summary <= q.room as up, case when cost - summary <= q.room then q.room - (cost - summary) else q.room end as room from j, q where m = 1
  union all select j.m, j.path, j.rank, j.cost - j.summary <= k.room, case when j.cost - j.summary <= k.room then k.room - (j.cost - j.summary) else k.room end from k join j on j.m = k.m + 1)
select h.path, h.rank, case when not shown then -1 when k.up then 2 when j.path is not null then 1 else 0 end::integer as level from h left join j on j.path = h.path left join k on k.path = h.path""",
)
def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = joins.ranked(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), "s_suppkey"])
    i = F.col("s_suppkey")
    files = s.select(i.alias("path"), F.col("rank").cast("long").alias("rank"), (20 + i % 7).alias("header"), (i * 31 % 90).alias("summary"), (2 * (i * 31 % 90) + i % 50).alias("cost"))
    return budget.detail_levels(files, 640).select("path", "rank", F.col("level").cast("int").alias("level"))


@query(
    "e69b_field_levels",
    f"""
with recursive lv as ({sql_of("e69_levels")}), f as (select s_suppkey as path, 20 + s_suppkey % 7 as header, s_suppkey * 31 % 90 as summary, 2 * (s_suppkey * 31 % 90) + s_suppkey % 50 as cost from supplier),
u as (select 2800 - coalesce(sum(case when level >= 2 then header + cost when level = 1 then header + summary when level = 0 then header else 0 end), 0) as room from lv join f using (path)),
a as (select path, row_number() over (order by rank) as n, 10 + path % 40 as c from lv where level >= 2 and path % 3 <> 0),
g(n, path, up, room, done) as (select 0::bigint, null::bigint, false, room, 0 from u
  union all select a.n, a.path, c <= room and done < 10, case when c <= room and done < 10 then room - c else room end, done + (c <= room and done < 10)::int from g join a on a.n = g.n + 1)
select lv.path, lv.rank, case when g.up then 3 else level end::integer as level from lv left join g on g.path = lv.path""",
)
def field_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The levels of e69_levels, and the fields of the first files in detail, with some more room than that."""
    i = F.col("s_suppkey")
    sizes = table(spark, sf_dir, "supplier").select(i.alias("path"), (20 + i % 7).alias("header"), (i * 31 % 90).alias("summary"), (2 * (i * 31 % 90) + i % 50).alias("cost"))
    fields = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(i.alias("path"), (10 + i % 40).alias("field_cost"))
    out = budget.promote_fields(levels(spark, sf_dir), sizes, fields, 700)
    return out.select("path", "rank", F.col("level").cast("int").alias("level"))


@query(
    "e70_overrides",
    _PATHS
    + """, r as (select * from (values ('^cmd/', 2), ('_test[.]go$', -1), ('[.]md$', 0), ('^cmd/.*[.]md$', 1)) as r(pattern, forced))
select path, doc_id as rank, coalesce(arg_min(forced, pattern), any_value(doc_id % 3))::integer as level from t left join r on regexp_matches(path, pattern) group by path, doc_id""",
)
def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _paths(spark, sf_dir).select("path", F.col("doc_id").alias("rank"), (F.col("doc_id") % 3).cast("int").alias("level"))
    rules = spark.createDataFrame([("^cmd/", 2), ("_test[.]go$", -1), ("[.]md$", 0), ("^cmd/.*[.]md$", 1)], "pattern string, forced int")
    return budget.apply_overrides(files, rules)


@query(
    "e71_spine",
    _PATHS
    + """, u as (select path, max(entry) as entry, bool_or(test) as test, max(depth) as depth, max(doc_id % 1000) as score, max(base) as base from t group by 1),
a as (select 0 as turn, 0 as score, path from u where entry > 0 order by base = 'main.go' desc, depth, path limit 1),
z as (select 1 as turn, score, path from u where entry = 0 and not test and depth <= 1 order by score desc, path limit 5)
select (row_number() over (order by turn, score desc, path))::integer as pos, path from (select * from a union all select * from z)""",
)
def spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summaries.spine(_paths(spark, sf_dir).groupBy("path").agg(F.max(F.col("doc_id") % 1000).alias("score")))


@query(
    "e72_groups",
    """
with g as (select o_orderkey, ['test', 'docs', 'chore', 'feat', 'fix'][1 + o_custkey % 5] as kind, case when o_orderkey % 3 = 0 then '' else 'store' end as scope, 1 + o_orderkey % 4 as files, o_orderkey % 5 as added, o_orderkey % 2 as removed, o_orderkey % 3 as modified from orders),
s as (select *, concat_ws(', ', case when added > 0 then 'add ' || added || ' symbols' end, case when modified > 0 then 'change ' || modified end, case when removed > 0 then 'drop ' || removed end) as say from g)
select o_orderkey, least(0.95, greatest(0.3, round(coalesce(map {'test': 0.7, 'docs': 0.7, 'chore': 0.6, 'feat': 0.5}[kind], 0.4) + case when scope <> '' then 0.05 else 0 end + case when files = 1 then 0.05 else 0 end, 2)))::double as confidence,
  left(case when scope <> '' then kind || '(' || scope || '): ' else kind || ': ' end || case when say = '' then 'update files' else say end, 72) as subject,
  regexp_matches(kind || case when o_orderkey % 2 = 0 then '(a)!: b' else ' b' end, '^(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)([(][^)]+[)])?!?: .+') as conventional from s""",
)
def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    g = table(spark, sf_dir, "orders").select("o_orderkey", _pick(["test", "docs", "chore", "feat", "fix"], F.col("o_custkey")).alias("kind"), F.when(i % 3 == 0, "").otherwise("store").alias("scope"), (1 + i % 4).alias("files"), (i % 5).alias("added"), (i % 2).alias("removed"), (i % 3).alias("modified"))
    message = F.concat("kind", F.when(i % 2 == 0, "(a)!: b").otherwise(" b"))
    c = F.col
    return g.select("o_orderkey", summaries.group_confidence(c("kind"), c("scope"), c("files")).alias("confidence"), summaries.subject(c("kind"), c("scope"), c("added"), c("removed"), c("modified")).alias("subject"), summaries.is_conventional(message).alias("conventional"))


@query(
    "e73_consolidated",
    """
with g as (select o_orderkey as id, o_custkey % 40 as top, o_orderkey % 7 as files from orders),
b as (select top, id as target from (select *, row_number() over (partition by top order by files desc, id) as r from g where files > 2) where r = 1)
select id, case when files <= 2 and target is not null then target else id end as into_ from g left join b using (top)""",
)
def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("o_orderkey")
    return summaries.consolidated(table(spark, sf_dir, "orders").select(i.alias("id"), (F.col("o_custkey") % 40).alias("top"), (i % 7).alias("files"))).withColumnRenamed("into", "into_")


@query(
    "e74_hygiene",
    _PATHS
    + """, tr as (select distinct path from t where doc_id % 3 > 0), un as (select distinct path from t where doc_id % 3 = 0), ig as (select distinct path from t where starts_with(path, 'dist/'))
select 'tracked' as what, count(*) as n from tr union all select 'untracked', count(*) from un union all select 'ignored', count(*) from ig union all select 'tracked_but_ignored', count(*) from tr join ig using (path)""",
)
def hygiene(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _paths(spark, sf_dir)
    return summaries.hygiene(p.where("doc_id % 3 > 0"), p.where("doc_id % 3 = 0"), p.where(F.startswith("path", F.lit("dist/"))))


@query(
    "e75_triage",
    "select file, line, kind, left(text, 200) as snippet, action from (select doc_id as file, n_chars as line, source as kind, coalesce(text, '') as text, case when lang = 'de' then 'review' else 'pass' end as action from documents) where action = 'review' order by file, line, kind limit 5",
)
def triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return summaries.triage(d.select(F.col("doc_id").alias("file"), F.col("n_chars").alias("line"), F.col("source").alias("kind"), F.coalesce("text", F.lit("")).alias("snippet"), F.when(F.col("lang") == "de", "review").otherwise("pass").alias("action")))


@query("e76_bump_levels", "select o_custkey, case when bool_or(o_totalprice > 480000) then 'major' when bool_or(o_orderpriority = '1-URGENT') then 'minor' else 'patch' end as bump from orders group by 1")
def bump_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("o_orderpriority") == "1-URGENT", "feat").otherwise("fix")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(classify.bump_level(kind, F.col("o_totalprice") > 480000).alias("bump"))


@query("e77_symbol_counts", "select lower(p_type) as kind, count(*) as n, count(*) filter (p_size > 5) as exported from part group by 1")
def symbol_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols = table(spark, sf_dir, "part").select(F.lower("p_type").alias("kind"), (F.col("p_size") > 5).alias("exported"))
    return summaries.symbol_counts(symbols)


@query(
    "e78_adjacent",
    "select o_custkey, o_orderkey, o_orderstatus from (select *, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as before from orders) where before is null or before <> o_orderstatus",
)
def adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return joins.adjacent_distinct(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus").select("o_custkey", "o_orderkey", "o_orderstatus")


@query("e79_uniform", "select o_custkey, count(*) as n, case when count(distinct o_orderstatus) = 1 then min(o_orderstatus) end as only from orders group by 1")
def uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.uniform(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", "only")


# A supplier's line items are the lines of a file; some open or close comments and raw strings.
_WRAPS = ["@", "/* @", "@ */", "// @", "@ // `x", "q := `@", "@`", 'w("/*", @)', "@ /* one */ @", "u(`@`)", "@", "@"]
_FILES = f"""
with i as (select l_suppkey as s, l_orderkey * 10 + l_linenumber as pos, l_partkey, replace({_list(_WRAPS)}[1 + l_partkey % {len(_WRAPS)}], '@', replace({_list(LINES)}[1 + (l_orderkey + l_linenumber) % {len(LINES)}], '#', l_linenumber::varchar)) as text from lineitem),
f as (select 'g_' || s || '.go' as path, string_agg(text, chr(10) order by pos, l_partkey, text) as content from i group by s),
k as (select path, string_split_regex(content, '{{tok}}') as p, regexp_extract_all(content, '{{tok}}') as t from f),
m as (select path, array_to_string(list_transform(range(1, len(p) + 1), lambda i: p[i] || case when t[i] is null then '' when regexp_matches(t[i], '^["'']') or (starts_with(t[i], '`') and not contains(t[i], chr(10)) and regexp_matches(t[i], '^`[^`]*`$')) then t[i] else repeat(chr(10), length(t[i]) - length(replace(t[i], chr(10), ''))) end), '') as content from k),
n as (select path, string_split(content, chr(10)) as ls from m),
l as (select path, line::integer as line, regexp_replace(ls[line], '^[ \\t\\r\\f]+|[ \\t\\r\\f]+$', '', 'g') as text from (select path, ls, unnest(range(1, len(ls) + 1)) as line from n))""".replace(
    "{tok}", r"""//[^\n]*|/\*(?:[^*]|\*+[^*/])*(?:\*+/|\*?$)|`[^`]*(?:`|$)|"(?:\\.|[^"\\\n])*(?:"|$)|''(?:\\.|[^''\\\n])*(?:''|$)"""
)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, content: every supplier's line items as a file."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")
    line = F.replace(_pick(LINES, F.col("l_orderkey") + F.col("l_linenumber")), F.lit("#"), F.col("l_linenumber").cast("string"))
    text = F.replace(_pick(_WRAPS, F.col("l_partkey")), F.lit("@"), line)
    pos = (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos")
    rows = li.select("l_suppkey", F.struct(pos, "l_partkey", text.alias("text")).alias("x"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["text"]), "\n")
    return rows.groupBy("l_suppkey").agg(joined.alias("content")).select(F.concat(F.lit("g_"), F.col("l_suppkey").cast("string"), F.lit(".go")).alias("path"), "content")


def _masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.masked_lines(cut(_files(spark, sf_dir)))  # the files are gathered once for all passes over their lines


@query("e99_masked_lines", _FILES + " select path, line, text from l")
def masked_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked(spark, sf_dir)


@query("e99b_masked_effects", _FILES + _scan_sql(audit.EFFECTS).removeprefix(_PROGRAM))
def masked_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scan(_masked(spark, sf_dir), audit.EFFECTS).drop("pattern")


@query("e99c_masked_surface", _FILES + _scan_sql(audit.SURFACE).removeprefix(_PROGRAM))
def masked_surface(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.scan(_masked(spark, sf_dir), audit.SURFACE).drop("pattern")


@query("e99d_masked_routes", _FILES + sql_of("e56_routes").removeprefix(_PROGRAM))
def masked_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.routes(_masked(spark, sf_dir))
