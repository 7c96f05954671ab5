"""From changed files to a plan of change groups: weighted edges, clusters, types, scopes, subjects and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from quarrydeck.functions.classify import change_type, is_test_file
from quarrydeck.functions.text import dirname, stem
from quarrydeck.operators import changes as ch
from quarrydeck.operators import joins, summaries

#: Change sets with more files say nothing about which files belong together.
MASS_EDIT = 200


def edges(changed: DataFrame, depends: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """a, b, weight, reason of pairs of changed files: a test and what it tests, dependencies, joint changes, and siblings of a type.

    changed: path; depends: src, dst; history: set, item (earlier change sets).
    Siblings are joined in a chain by path, which connects them without making all their pairs.
    """
    own = changed.select("path").distinct()
    kinds = own.select("path", dirname(F.col("path")).alias("folder"), change_type(F.col("path")).alias("type"), is_test_file(F.col("path")).alias("test"))
    base = F.regexp_replace(stem(F.col("path")), r"^test_|_test$|_spec$|\.test$|\.spec$|Tests?$", "")
    tests = kinds.where("test").select("folder", base.alias("base"), F.col("path").alias("a"))
    plain = kinds.where("not test").select("folder", stem(F.col("path")).alias("base"), F.col("path").alias("b"))
    edge = lambda df, reason: df.select("a", "b", F.lit(ch.WEIGHTS[reason]).alias("weight"), F.lit(reason).alias("reason"))
    out = edge(tests.join(plain, ["folder", "base"]), "test-pair")
    dep = depends.join(own.select(F.col("path").alias("src")), "src", "left_semi").join(own.select(F.col("path").alias("dst")), "dst", "left_semi")
    out = out.union(edge(dep.select(F.col("src").alias("a"), F.col("dst").alias("b")), "symbol-dep"))
    if history is not None:
        inside = history.join(own.select(F.col("path").alias("item")), "item", "left_semi")
        out = out.union(edge(ch.co_change(inside, "set", "item", most=MASS_EDIT), "co-change"))
    w = Window.partitionBy("folder", "type").orderBy("path")
    chain = kinds.select(F.lag("path").over(w).alias("a"), F.col("path").alias("b")).where("a is not null")
    plugin = lambda c: F.regexp_extract(c, r"^plugins/([^/]+)/", 1)
    return ch.combined(out.union(edge(chain, "sibling"))).where((plugin("a") == plugin("b")) | (plugin("a") == "") | (plugin("b") == ""))


def plan(changed: DataFrame, depends: DataFrame, deltas: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """group, paths, type, scope, files, confidence, breaking, subject of each change group, in order of its first path.

    deltas: path, name, change, breaking (see operators.changes.delta).
    """
    pairs = edges(changed, depends, history).persist()
    ids = changed.select("path").distinct().select(F.xxhash64("path").alias("node"), "path")
    by = lambda c: F.xxhash64(c)
    joined = ch.clusters(ids.select("node"), pairs.select(by("a").alias("a"), by("b").alias("b"), "weight"))
    members = joined.join(ids, "node").select("component", "node", "path", change_type(F.col("path")).alias("type"))
    facts = ch.cluster_facts(members, pairs.select(by("a").alias("a"), by("b").alias("b"), "weight"))
    kind = joins.mode(members, "component", "type").select("component", "type")
    tops = members.groupBy("component").agg(F.array_sort(F.collect_set("path")).alias("paths"), F.min(dirname(F.col("path"))).alias("lo"), F.max(dirname(F.col("path"))).alias("hi"))
    scope = F.when((F.col("lo") == F.col("hi")) & (F.col("lo") != "."), F.substring_index("lo", "/", -1)).otherwise("")
    rows = tops.withColumn("scope", scope).drop("lo", "hi").join(facts, "component").join(kind, "component")
    if deltas is not None:
        d = deltas.join(members.select("path", "component"), "path").groupBy("component").agg(*[F.sum((F.col("change") == c).cast("int")).alias(c) for c in ("added", "removed", "modified")], F.bool_or("breaking").alias("breaking"))
        rows = rows.join(d, "component", "left")
    else:
        rows = rows.select("*", *[F.lit(0).alias(c) for c in ("added", "removed", "modified")], F.lit(False).alias("breaking"))
    rows = rows.fillna(0, ["added", "removed", "modified"]).withColumn("breaking", F.coalesce("breaking", F.lit(False)))
    said = summaries.subject(F.col("type"), F.col("scope"), F.col("added"), F.col("removed"), F.col("modified"))
    return rows.select(F.element_at("paths", 1).alias("group"), "paths", "type", "scope", "files", "confidence", "breaking", said.alias("subject")).orderBy("group")


#: Confidence from which a group's subject stands as it is, and from which its plain wording does.
SURE, PLAIN_SURE = 0.75, 0.6
# Findings to review and unsure groups beyond which a plan is given up.
MOST_FINDINGS, MOST_UNSURE = 5, 3


def prepared(groups: DataFrame, findings: DataFrame, key: str = "plan", large: int | None = None) -> DataFrame:
    """key, groups, unsure, findings, status of each plan: abort, needs_judgment or ready.

    groups: key, files, confidence, polished (that of the plain wording, see summaries.polished);
    findings: key, action. A group is unsure if neither wording is sure enough, or if it has more
    than ``large`` files. Plans without groups have no row.
    """
    unsure = (F.col("confidence") < SURE) & (F.col("polished") < PLAIN_SURE)
    if large is not None:
        unsure = unsure | (F.col("files") > large)
    by = groups.groupBy(key).agg(F.count(F.lit(1)).alias("groups"), F.sum(unsure.cast("long")).alias("unsure"))
    found = findings.where("action = 'review'").groupBy(key).agg(F.count(F.lit(1)).alias("findings"))
    rows = by.join(found, key, "left").fillna(0, ["findings"])
    n, m = F.col("findings"), F.col("unsure")
    return rows.withColumn("status", F.when((n > MOST_FINDINGS) | (m > MOST_UNSURE), "abort").when((n > 0) | (m > 0), "needs_judgment").otherwise("ready"))
