"""Queries over the relational tables seen as symbols, imports, edges and changes, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrydeck.functions import classify, text as T
from quarrydeck.operators import changes, graph, joins, ranking, summaries
from quarrydeck.operators.budget import greedy, header_cutoff
from quarrydeck.sources import snapshots
from quarrydeck.sources.adapters import order_imports, part_symbols, table

from .registry import query

# A few dozen rows: kinds of parts, their labels and bumps.
RULES = [("econ", "ECON", 5), ("std", "STAND", 3), ("promo", "PROMO", 5), ("big", "LARGE", 5), ("any", "S", 5)]
_RULES_SQL = "(values " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in RULES) + ") as r(label, prefix, bump)"


@query(
    "e01_find_ladder",
    """
select path, name, kind, line, match from (
  select lower(p_brand) || '/part_' || p_partkey as path, p_name as name, lower(p_type) as kind, p_size as line,
         case when p_name = 'red ring' then 100 when lower(p_name) = 'red ring' then 75
              when starts_with(p_name, 'red ring') then 50 when contains(lower(p_name), 'red ring') then 25 end as match
  from part)
where match is not null and kind = 'promo'""",
)
def find_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.find_ladder(part_symbols(spark, sf_dir), "red ring", kind="PROMO").select("path", "name", "kind", "line", "match")


@query(
    "e02_handles",
    """
select 'symbol:' || 'nation_' || s_nationkey || '::' || s_name || '#supplier@' || s_suppkey as handle,
       'nation_' || s_nationkey as path, s_name as name, 'supplier' as kind, cast(s_suppkey as integer) as line from supplier""",
)
def handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    path = F.concat(F.lit("nation_"), F.col("s_nationkey").cast("string"))
    made = s.select(T.symbol_handle(path, F.col("s_name"), F.lit("supplier"), F.col("s_suppkey")).alias("handle"))
    return made.withColumn("h", T.parse_handle(F.col("handle"))).select("handle", "h.path", "h.name", "h.kind", "h.line")


@query(
    "e03_boundary_rules",
    f"""
with hits as (select distinct p_brand as path, label, bump from part, {_RULES_SQL} where starts_with(p_type, prefix))
select path, string_agg(label, ',' order by label) as labels, least(sum(bump), 15)::bigint as bump from hits group by path""",
)
def boundary_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    imports = table(spark, sf_dir, "part").select(F.col("p_brand").alias("path"), F.col("p_type").alias("imp"))
    return joins.prefix_rules(imports, spark.createDataFrame(RULES, "label string, prefix string, bump int"))


@query(
    "e04_importers",
    """
select l_partkey as imp, count(distinct l_orderkey) as imported_by,
       (case when count(distinct l_orderkey) <= 8 then count(distinct l_orderkey) * 10 else count(distinct l_orderkey) + 72 end)::bigint as score
from lineitem group by 1""",
)
def importers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.importer_counts(order_imports(spark, sf_dir))


@query(
    "e05_symbol_bonus",
    """
select lower(p_brand) || '/' || p_name as path, least(sum(case when p_type in ('LARGE', 'PROMO') then 3 when p_type = 'SMALL' then 2 else 1 end), 20)::bigint as bonus
from part where p_size > 5 group by 1""",
)
def symbol_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_type").isin("LARGE", "PROMO"), "interface").when(F.col("p_type") == "SMALL", "struct").otherwise("function")
    symbols = p.select(F.concat(F.lower("p_brand"), F.lit("/"), F.col("p_name")).alias("path"), kind.alias("kind"), (F.col("p_size") > 5).alias("exported"))
    return joins.symbol_bonus(symbols)


_PARTS_SQL = """
with f as (select l_orderkey as key, count(distinct l_partkey) as n, sum(l_linenumber) as s, max(l_linenumber) as d from lineitem group by 1),
c as (select key, 'imports' as component, (case when n <= 8 then n * 10 else n + 72 end)::bigint as value from f
  union all select key, 'symbols', least(s, 20)::bigint from f
  union all select key, 'depth', least(0, 2 - d)::bigint from f
  union all select key, 'intra_refs', least(2 * n, 24)::bigint from f
  union all select key, 'intent', (s // 3)::bigint from f)"""


@query(
    "e06_component_tiers",
    _PARTS_SQL
    + """
select key, case component when 'intra_refs' then 'lexical' when 'intent' then 'contextual' else 'structural' end as tier, sum(value)::bigint as total
from c where value <> 0 group by 1, 2 having sum(value) <> 0""",
)
def component_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.tier_rollup(_components(spark, sf_dir), "key")


@query("e06b_components", _PARTS_SQL + " select key, component, value from c where value <> 0")
def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("key")).agg(F.countDistinct("l_partkey").alias("n"), F.sum("l_linenumber").alias("s"), F.max("l_linenumber").alias("d"))
    parts = {"imports": classify.import_score(F.col("n")), "symbols": F.least("s", F.lit(20)), "depth": classify.depth_penalty(F.col("d")), "intra_refs": F.least(2 * F.col("n"), F.lit(24)), "intent": F.expr("s div 3")}
    return ranking.component_rows(f, "key", parts)


_DAG_SQL = """
with recursive e as (
  select 'n' || n_nationkey as src, 'r' || n_regionkey as dst from nation
  union select 'c' || c_custkey, 'n' || c_nationkey from customer
  union select 's' || s_suppkey, 'n' || s_nationkey from supplier
  union select 'r' || r_regionkey, 'r' || (r_regionkey + 1) % 5 from region)"""


def _dag(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    t = lambda n: table(spark, sf_dir, n)
    a = t("nation").select(name("n", F.col("n_nationkey")).alias("src"), name("r", F.col("n_regionkey")).alias("dst"))
    b = t("customer").select(name("c", F.col("c_custkey")).alias("src"), name("n", F.col("c_nationkey")).alias("dst"))
    c = t("supplier").select(name("s", F.col("s_suppkey")).alias("src"), name("n", F.col("s_nationkey")).alias("dst"))
    d = t("region").select(name("r", F.col("r_regionkey")).alias("src"), name("r", (F.col("r_regionkey") + 1) % 5).alias("dst"))
    return a.union(b).union(c).union(d)


@query(
    "e07_transitive",
    _DAG_SQL
    + """, w(src, dst) as (select src, dst from e union select w.src, e.dst from w join e on w.dst = e.src)
select dst as key, count(distinct src) as dependents, least(5 * count(distinct src), 50)::bigint as score from w where src <> dst group by 1""",
)
def transitive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.transitive_scores(_dag(spark, sf_dir))


@query(
    "e08_package_deps",
    """
with e as (select distinct p_brand as src, 'supplier_' || l_suppkey as dst from lineitem join part on l_partkey = p_partkey)
select src as package, string_agg(dst, ',' order by dst) as deps, count(*) as n_deps from e group by 1""",
)
def package_deps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    edges = li.join(p, F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("src"), F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("dst"))
    return graph.package_deps(edges)


_CO_SQL = """
with o as (select distinct user_id as item, event_type || '@' || date_trunc('hour', ts) as g from events),
p as (select a.item as a, b.item as b, count(*) as n from o a join o b on a.g = b.g and a.item < b.item group by 1, 2)"""


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.date_format(F.date_trunc("hour", F.col("ts")), "yyyy-MM-dd HH")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("item"), F.concat(F.col("event_type"), F.lit("@"), hour).alias("g"))


@query(
    "e09_components",
    _CO_SQL.replace("with o", "with recursive o")
    + """, e as (select a as src, b as dst from p where n >= 2 union select b, a from p where n >= 2),
w(node, component) using key (node) as (select distinct src, src from e
  union select e.dst, min(w.component) from w join e on e.src = w.node join recurring.w c on c.node = e.dst where w.component < c.component group by e.dst)
select node, component from w""",
)
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.co_components(_changes(spark, sf_dir), "g", "item")


@query("e23_co_change", _CO_SQL + " select a, b, n from p where n >= 2")
def co_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.co_change(_changes(spark, sf_dir), "g", "item", 2)


@query(
    "e15_scalars",
    """
select p_partkey, trim(regexp_replace(lower(p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-') as slug,
       (strlen(p_name) + 3) // 4 as tokens, replace(replace(p_name || ' & <' || p_brand || '>', '&', '&amp;'), '<', '&lt;').replace('>', '&gt;') as escaped,
       greatest(1, p_size - 2) as start_line, p_size + 24 as end_line
from part""",
)
def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey",
        T.slug(F.concat(F.col("p_name"), F.lit(" & "), F.col("p_brand"))).alias("slug"),
        T.token_estimate(F.col("p_name")).alias("tokens"),
        T.xml_escape(F.concat(F.col("p_name"), F.lit(" & <"), F.col("p_brand"), F.lit(">"))).alias("escaped"),
        F.greatest(F.lit(1), F.col("p_size") - 2).alias("start_line"),
        (F.col("p_size") + 24).alias("end_line"),
    )


@query(
    "e16_header_cutoff",
    """
with r as (select p_partkey, p_retailprice, strlen(p_name) + 30 as header, sum(strlen(p_name) + 30) over (order by p_retailprice desc, p_partkey rows unbounded preceding) as used from part)
select p_partkey, used::bigint as used, used <= 35840 as shown from r""",
)
def header(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", (F.octet_length("p_name") + 30).alias("header"))
    return header_cutoff(p, ["-p_retailprice", "p_partkey"], "header", 35840).select("p_partkey", F.col("used").cast("long").alias("used"), "shown")


@query(
    "e17_greedy",
    """
with recursive i as (select row_number() over (order by s_acctbal desc, s_suppkey) as n, s_suppkey, (s_suppkey * 37 % 101 + 5)::bigint as cost from supplier),
g as (select n, s_suppkey, cost <= 1500 as taken, case when cost <= 1500 then cost else 0 end as used from i where n = 1
  union all select i.n, i.s_suppkey, g.used + i.cost <= 1500, case when g.used + i.cost <= 1500 then g.used + i.cost else g.used end from g join i on i.n = g.n + 1)
select s_suppkey, taken, used::bigint as used from g""",
)
def greedy_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    items = s.select("s_suppkey", "s_acctbal", (F.col("s_suppkey") * 37 % 101 + 5).alias("cost"))
    return greedy(items, ["-s_acctbal", "s_suppkey"], "cost", 1500, "s_suppkey")


@query(
    "e18_caps",
    """
select o_custkey, o_orderkey, pos, total, total > 5 as truncated from (
  select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::integer as pos, count(*) over (partition by o_custkey) as total from orders)
where pos <= 5""",
)
def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return joins.capped_rows(o, ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 5).select("o_custkey", "o_orderkey", "pos", "total", "truncated")


@query("e19_first_seen", "select user_id, event_type, min(event_id) as event_id from events group by 1, 2")
def first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.first_seen(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("e20_orphans", "select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_returnflag = 'R' and year(l_shipdate) = 1996)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_shipdate >= timestamp'1996-01-01' and l_shipdate < timestamp'1997-01-01'").select(F.col("l_partkey").alias("p_partkey"))
    return joins.orphans(table(spark, sf_dir, "part").select("p_partkey", "p_name"), used, "p_partkey")


@query(
    "e21_delta",
    """
with pre as (select o_custkey as k, o_orderpriority as name, max(o_orderstatus) as v, bool_or(o_totalprice > 250000) as ex from orders where o_orderdate < '1998-01-01' group by 1, 2),
post as (select o_custkey as k, o_orderpriority as name, max(o_orderstatus) as v, bool_or(o_totalprice > 250000) as ex from orders where o_orderdate >= '1998-01-01' group by 1, 2)
select * from (
  select coalesce(pre.k, post.k) as k, coalesce(pre.name, post.name) as name,
         case when pre.k is null then 'added' when post.k is null then 'removed' when pre.v <> post.v then 'modified' end as change,
         case when pre.k is null then false when post.k is null then pre.ex when pre.v <> post.v then pre.ex and post.ex else false end as breaking
  from pre full join post on pre.k = post.k and pre.name = post.name)
where change is not null""",
)
def delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")

    def side(rows: DataFrame) -> DataFrame:
        return rows.groupBy(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("name")).agg(F.max("o_orderstatus").alias("v"), F.bool_or(F.col("o_totalprice") > 250000).alias("exported"))

    return changes.delta(side(o.where("o_orderdate < timestamp'1998-01-01'")), side(o.where("o_orderdate >= timestamp'1998-01-01'")), ["k"], "name", "v")


@query(
    "e22_sets",
    """
select 'with_orders' as what, c_mktsegment, count(*) as n from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') group by 2
union all select 'without', c_mktsegment, count(*) from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') group by 2
union all select 'segments', c_mktsegment, 1 from (select c_mktsegment from customer union select c_mktsegment from customer where c_acctbal < 0)""",
)
def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    urgent = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    count = lambda df, what: df.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "c_mktsegment", "n")
    seg = c.select("c_mktsegment").union(c.where("c_acctbal < 0").select("c_mktsegment")).distinct().select(F.lit("segments").alias("what"), "c_mktsegment", F.lit(1).cast("long").alias("n"))
    return count(c.join(urgent, "c_custkey", "left_semi"), "with_orders").union(count(c.join(urgent, "c_custkey", "left_anti"), "without")).union(seg)


_EDGES_SQL = """
with e as (
  select least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b, 0.8 as weight, 'symbol-dep' as reason from lineitem where l_quantity > 45
  union all select least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey), 0.3, 'sibling' from lineitem where l_quantity <= 45 and l_tax >= 0.04
  union all select least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey), 0.5, 'co-change' from lineitem where l_quantity <= 45 and l_tax < 0.04),
t as (select a, b, max(weight) as weight from e where a <> b group by 1, 2)"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line item is an edge between its part and its supplier, of a kind by its quantity and tax."""
    reason = F.when(F.col("l_quantity") > 45, "symbol-dep").when(F.col("l_tax") >= 0.04, "sibling").otherwise("co-change")
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), reason.alias("reason"))
    return li.select("a", "b", classify.lookup(changes.WEIGHTS, F.col("reason")).alias("weight"), "reason")


@query("e24_edges", _EDGES_SQL + " select t.a, t.b, t.weight::double as weight, min(reason) as reason from t join e on e.a = t.a and e.b = t.b and e.weight = t.weight group by 1, 2, 3")
def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changes.combined(_edges(spark, sf_dir))


@query(
    "e24b_clusters",
    _EDGES_SQL.replace("with e as", "with recursive e as")
    + """, g as (select a as src, b as dst from t where weight >= 0.75 union select b, a from t where weight >= 0.75),
w(node, component) using key (node) as (select distinct src, src from g
  union select g.dst, min(w.component) from w join g on g.src = w.node join recurring.w c on c.node = g.dst where w.component < c.component group by g.dst),
n as (select a as node from t union select b from t)
select n.node, coalesce(component, n.node) as component from n left join w on w.node = n.node""",
)
def cluster_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = changes.combined(_edges(spark, sf_dir))
    nodes = e.select(F.col("a").alias("node")).union(e.select("b"))
    return changes.clusters(nodes, e)


@query("e25_ownership", "select s_nationkey, count(*) as files, round(sum(s_acctbal), 2) as score from supplier group by 1 having count(*) >= 2")
def ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return joins.ownership(s, "s_nationkey", "s_acctbal").withColumn("score", F.round("score", 2))


@query(
    "e26_mode",
    """
select o_custkey, o_orderpriority, n from (
  select *, row_number() over (partition by o_custkey order by n desc, o_orderpriority) as r from (select o_custkey, o_orderpriority, count(*) as n from orders group by 1, 2)) where r = 1""",
)
def mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.mode(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority")


@query(
    "e32_division",
    """
with l as (select distinct l_suppkey, p_brand || p_type as item from lineitem join part on l_partkey = p_partkey)
select s_suppkey from supplier where not exists (select 1 from (select distinct p_brand || p_type as item from part) t where not exists (select 1 from l where l.l_suppkey = s_suppkey and l.item = t.item))""",
)
def division(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.col("l_partkey").alias("p_partkey"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", "p_type").alias("item"))
    return joins.divides(li.join(p, "p_partkey"), p, "s_suppkey", "item")


@query(
    "e34_range_join",
    """
with s as (select event_id as span, user_id, epoch_us(ts) as a, epoch_us(ts) + 3600000000 as b from events where event_type = 'signup')
select span, count(*) as n, round(sum(value), 4) as total from s join (select user_id, epoch_us(ts) as t, value from events where event_type = 'click') e
on e.user_id = s.user_id and t between a and b group by 1""",
)
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")))
    spans = e.where("event_type = 'signup'").select(F.col("event_id").alias("span"), "user_id", F.col("t").alias("a"), (F.col("t") + 3_600_000_000).alias("b"))
    points = e.where("event_type = 'click'").select("user_id", "t", "value")
    return joins.within(points, spans, "t", "a", "b", "user_id", 3_600_000_000).groupBy("span").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "e36_consumed",
    """
with r as (select s_suppkey as path, trunc(s_acctbal - 3000)::bigint as score, s_nationkey < 4 as consumed from supplier),
d as (select distinct l_suppkey as path, l_suppkey + l_linenumber as dep from lineitem),
g as (select d.path, least(15 * count(*), 45) as gain from d join r on d.dep = r.path where r.consumed group by 1)
select r.path, score as before, consumed, ((case when consumed then trunc(score / 2)::bigint else score end) + coalesce(gain, 0))::bigint as score from r left join g using (path)""",
)
def consumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("path"), (F.col("s_acctbal") - 3000).cast("long").alias("score"), "s_nationkey")
    deps = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("path"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("dep"))
    return ranking.consumed_rerank(s.drop("s_nationkey"), s.where("s_nationkey < 4").select("path"), deps)


@query(
    "e35_lanes",
    """
with f as (select distinct case l_returnflag when 'R' then 'returns' when 'A' then 'accepted' else 'open' end as lane, 'line_' || l_linenumber || '_' || l_linestatus as path from lineitem)
select lane, count(*) as n_files, string_agg(path, ',' order by path) as files from f group by 1""",
)
def lane_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quarrydeck.operators.audit import lanes

    li = table(spark, sf_dir, "lineitem")
    lane = F.when(F.col("l_returnflag") == "R", "returns").when(F.col("l_returnflag") == "A", "accepted").otherwise("open")
    return lanes(li.select(lane.alias("lane"), F.concat(F.lit("line_"), F.col("l_linenumber").cast("string"), F.lit("_"), F.col("l_linestatus")).alias("path")))


@query(
    "e37_dependency_bumps",
    """
with m as (select c_nationkey as path, c_mktsegment as name, min(c_custkey) as old from customer where c_acctbal < 2000 group by 1, 2),
p as (select c_nationkey as path, c_mktsegment as name, min(c_custkey) as new from customer where c_acctbal > 8000 group by 1, 2)
select coalesce(m.path, p.path) as path, coalesce(m.name, p.name) as name, case when new is null then 'drop' when old is null then 'add' else 'bump' end as action, old, new
from m full join p on m.path = p.path and m.name = p.name where old is null or new is null or old <> new""",
)
def bumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    side = lambda cond, sign: c.where(cond).groupBy(F.col("c_nationkey").alias("path"), F.col("c_mktsegment").alias("name")).agg(F.min("c_custkey").alias("version")).withColumn("sign", F.lit(sign))
    return changes.dependency_bumps(side("c_acctbal < 2000", "-").unionByName(side("c_acctbal > 8000", "+")))


@query(
    "e38_rank",
    "select s_suppkey, s_acctbal, row_number() over (order by s_acctbal desc, s_suppkey)::integer as rank from supplier order by s_acctbal desc, s_suppkey limit 20",
)
def rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.ranked(table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal"), [F.desc("s_acctbal"), "s_suppkey"], limit=20)


@query(
    "e39_risk_levels",
    """
with i as (select p_partkey, p_size, count(distinct l_suppkey) as n, max(l_tax) as t from part join lineitem on l_partkey = p_partkey group by 1, 2)
select p_partkey, n, case when n > 10 or (p_size > 45 and n > 3) then 'high' when n > 3 or p_size > 45 or t < 0.02 then 'medium' else 'low' end as risk from i""",
)
def risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_tax")
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    i = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey", "p_size").agg(F.countDistinct("l_suppkey").alias("n"), F.max("l_tax").alias("t"))
    return i.select("p_partkey", "n", classify.impact_risk(F.col("n"), (F.col("p_size") > 45).cast("int"), F.col("t") < 0.02).alias("risk"))


@query(
    "e40_cluster_confidence",
    """
with m as (select o_custkey as component, o_orderkey as node, o_orderpriority as type, o_orderstatus from orders)
select component, count(*) as files, count(distinct type) as types,
       round(greatest(0.3, 1.0 - (case when count(distinct type) > 1 then 0.2 else 0 end) - (case when count(*) > 3 then 0.1 * ((count(*) - 3) // 5 + 1) else 0 end)
         - (case when count(*) > 1 and not bool_or(o_orderstatus = 'F') then 0.15 else 0 end)), 2)::double as confidence
from m group by 1""",
)
def cluster_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("component"), F.col("o_orderkey").alias("node"), F.col("o_orderpriority").alias("type"), "o_orderstatus")
    strong = m.where("o_orderstatus = 'F'").select(F.col("node").alias("a"), F.col("node").alias("b"), F.lit(0.8).alias("weight"))
    return changes.cluster_facts(m.drop("o_orderstatus"), strong)


@query(
    "e41_status_merge",
    """
with old as (select c_custkey as path, c_mktsegment as v from customer where c_acctbal < 9000),
new as (select c_custkey as path, case when c_nationkey = 7 then 'X' || c_mktsegment else c_mktsegment end as v from customer where c_acctbal > -300)
select coalesce(old.path, new.path) as path, case when old.path is null then 'added' when new.path is null then 'deleted' when old.v = new.v then 'fresh' else 'modified' end as status
from old full join new on old.path = new.path""",
)
def status_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two(spark, sf_dir)
    return snapshots.status(old, new, "path", "v")


def _two(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "customer")
    old = c.where("c_acctbal < 9000").select(F.col("c_custkey").alias("path"), F.col("c_mktsegment").alias("v"))
    new = c.where("c_acctbal > -300").select(F.col("c_custkey").alias("path"), F.when(F.col("c_nationkey") == 7, F.concat(F.lit("X"), F.col("c_mktsegment"))).otherwise(F.col("c_mktsegment")).alias("v"))
    return old, new


@query("e31_incremental", "select c_custkey as path, case when c_nationkey = 7 then 'X' || c_mktsegment else c_mktsegment end as v from customer where c_acctbal > -300")
def incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _two(spark, sf_dir)
    changed = snapshots.status(old, new, "path", "v").where("status <> 'fresh'").join(new, "path", "left")
    return snapshots.merged(old, changed)


@query(
    "e42_dto_penalty",
    """
select p_brand || '/' || p_name as path, case when count(*) filter (p_size > 5) >= 1 and count(*) filter (p_size > 5 and p_type = 'PROMO') = 0
  and (count(*) filter (p_size > 5 and p_type in ('SMALL', 'LARGE')) = count(*) filter (p_size > 5)
    or (count(*) filter (p_size > 5 and p_type in ('SMALL', 'LARGE')) >= 4 and 5 * count(*) filter (p_size > 5 and p_type in ('SMALL', 'LARGE')) >= 4 * count(*) filter (p_size > 5)))
  then -12 else 0 end as dto from part group by 1""",
)
def dto(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    n = lambda cond: F.coalesce(F.sum(F.expr(f"cast({cond} as int)")), F.lit(0))
    c = p.groupBy(F.concat("p_brand", F.lit("/"), "p_name").alias("path")).agg(n("p_size > 5").alias("e"), n("p_size > 5 and p_type = 'PROMO'").alias("f"), n("p_size > 5 and p_type in ('SMALL', 'LARGE')").alias("d"))
    return c.select("path", classify.dto_penalty(F.col("e"), F.col("d"), F.col("f")).alias("dto"))


@query(
    "e43_caller_bonus",
    """
with n as (select distinct lower(p_brand) as path, p_name as name from part),
c as (select distinct 'c' || c_nationkey as by_file, (['red ring', 'blue bolt', 'small ring', 'red widget'])[1 + (length(c_mktsegment) % 4)::integer] as name from customer)
select path, count(distinct by_file) as callers, least(4 * count(distinct by_file), 32)::bigint as bonus from n join c using (name) group by 1""",
)
def caller_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = part_symbols(spark, sf_dir).select(F.regexp_replace("path", "/.*", "").alias("path"), "name").distinct()
    pick = F.element_at(F.array(*[F.lit(x) for x in ("red ring", "blue bolt", "small ring", "red widget")]), (1 + F.length("c_mktsegment") % 4).cast("int"))
    calls = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), F.col("c_nationkey").cast("string")).alias("path"), F.concat(pick, F.lit("()")).alias("name"))
    n = joins.call_site_counts(calls, names)
    return n.select("path", "callers", F.least(4 * F.col("callers"), F.lit(32)).cast("long").alias("bonus"))


@query(
    "e44_lcp",
    """
with e as (select p_brand, min(p_type || 'Of' || p_name) as lo, max(p_type || 'Of' || p_name) as hi from (select p_brand || p_type as p_brand, p_type, p_name from part) group by 1),
f as (select *, list_max(list_filter(range(0, least(length(lo), length(hi)) + 1), lambda n: left(lo, n) = left(hi, n))) as n from e)
select p_brand, case when lo = hi then lo else regexp_replace(left(lo, n), '[A-Z]?[a-z0-9]*$', '') end as prefix from f""",
)
def common_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.concat("p_brand", "p_type").alias("p_brand"), F.concat("p_type", F.lit("Of"), "p_name").alias("name"))
    return summaries.common_prefix(p, "p_brand", "name")


@query(
    "e45_top_symbols",
    "select p_brand, string_agg(p_name, ', ' order by r) as top from (select p_brand, p_name, row_number() over (partition by p_brand order by p_retailprice desc, p_name, p_partkey) as r from part) where r <= 2 group by 1",
)
def top_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_brand", "p_name", "p_retailprice", "p_partkey")
    return joins.top_names(p, "p_brand", "p_name", [F.desc("p_retailprice"), "p_name", "p_partkey"], 2)
