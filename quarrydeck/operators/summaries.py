"""Summaries of groups: common prefixes, spines, subjects and consolidation of change groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrydeck.functions.classify import entry_boost, is_test_file
from quarrydeck.functions.text import basename, depth, extension

# What a group of changes is confident of before its scope and size.
BASE_CONFIDENCE = {"test": 0.7, "docs": 0.7, "chore": 0.6, "feat": 0.5}


def common_prefix(df: DataFrame, group: str, name: str) -> DataFrame:
    """group, prefix: the longest common prefix of a group's names (that of the least and the greatest), back to the last boundary."""
    ends = df.groupBy(group).agg(F.min(name).alias("lo"), F.max(name).alias("hi"))
    same = F.filter(F.sequence(F.lit(0), F.least(F.length("lo"), F.length("hi"))), lambda n: F.substring(F.col("lo"), F.lit(1), n) == F.substring(F.col("hi"), F.lit(1), n))
    prefix = F.substring(F.col("lo"), F.lit(1), F.array_max(same))
    whole = F.when(F.col("lo") == F.col("hi"), F.col("lo"))
    return ends.select(group, F.coalesce(whole, F.regexp_replace(prefix, r"[A-Z]?[a-z0-9]*$", ""), F.lit("")).alias("prefix"))


def spine(ranked: DataFrame, most: int = 5) -> DataFrame:
    """pos, path: the best entry file (main.go, then the shallowest), then the first files that aren't tests, at most one folder deep."""
    p = F.col("path")
    entry = ranked.where(entry_boost(p) > 0).orderBy(F.desc(basename(p) == "main.go"), depth(p), p).limit(1).select(F.lit(0).alias("turn"), F.lit(0).cast("long").alias("score"), "path")
    rest = ranked.where((entry_boost(p) == 0) & ~is_test_file(p) & (depth(p) <= 1)).orderBy(F.desc("score"), p).limit(most).select(F.lit(1).alias("turn"), F.col("score").cast("long").alias("score"), "path")
    return entry.union(rest).withColumn("pos", F.row_number().over(Window.orderBy("turn", F.desc("score"), "path"))).select("pos", "path")


def group_confidence(kind: Column, scope: Column, files: Column, table: dict[str, float] = BASE_CONFIDENCE) -> Column:
    base = F.lit(0.4)
    for k, v in table.items():
        base = F.when(kind == k, v).otherwise(base)
    return F.least(F.lit(0.95), F.greatest(F.lit(0.3), F.round(base + F.when(scope != "", 0.05).otherwise(0.0) + F.when(files == 1, 0.05).otherwise(0.0), 2)))


def subject(kind: Column, scope: Column, added: Column, removed: Column, modified: Column) -> Column:
    """A one-line subject of a change group from the numbers of its symbols that came, went and changed; at most 72 characters."""
    say = F.concat_ws(", ", F.when(added > 0, F.format_string("add %d symbols", added)), F.when(modified > 0, F.format_string("change %d", modified)), F.when(removed > 0, F.format_string("drop %d", removed)))
    head = F.when(scope != "", F.format_string("%s(%s): ", kind, scope)).otherwise(F.concat(kind, F.lit(": ")))
    return F.substring(F.concat(head, F.when(say == "", F.lit("update files")).otherwise(say)), 1, 72)


def consolidated(groups: DataFrame, small: int = 2) -> DataFrame:
    """id, into: groups of at most ``small`` files fold into the largest other group of the same top folder; others stay. groups: id, top, files."""
    large = groups.where(F.col("files") > small)
    w = Window.partitionBy("top").orderBy(F.desc("files"), "id")
    best = large.withColumn("_pos", F.row_number().over(w)).where("_pos = 1").select("top", F.col("id").alias("target"))
    return groups.join(best, "top", "left").select("id", F.when((F.col("files") <= small) & F.col("target").isNotNull(), F.col("target")).otherwise(F.col("id")).alias("into"))


def merged_plans(groups: DataFrame, most: int = 3, small: int = 2) -> DataFrame:
    """plan, id, into, files: the groups of each plan put together until at most ``most`` are left; files: those of the group it goes into.

    groups: plan, id, files, tops (top folders of the group's files; the first names the group's
    place). Plans of ``most`` groups or fewer stay. In others, groups are taken by falling files,
    then id; those of at most ``small`` files join the first group before them (larger ones come
    first) whose place they touch, and stay where none is. Then the last two become one, under the
    name of the larger, and are sorted in again, until ``most`` are left. All plans go at once;
    a plan is one row. Groups with null files count none; null tops touch no place.
    """
    g = F.struct((-F.coalesce("files", F.lit(0))).cast("long").alias("nf"), "id", F.coalesce(F.get("tops", F.lit(0)), F.lit("")).alias("place"), F.coalesce("tops", F.array().cast("array<string>")).alias("tops"), F.array("id").alias("ids"))
    plans = groups.groupBy("plan").agg(F.array_sort(F.collect_list(g)).alias("gs"))
    join = lambda a, b: F.struct((a["nf"] + b["nf"]).alias("nf"), a["id"].alias("id"), a["place"].alias("place"), a["tops"].alias("tops"), F.concat(a["ids"], b["ids"]).alias("ids"))

    def ride(out: Column, r: Column) -> Column:
        at = F.array_position(F.transform(out, lambda x: F.array_contains(r["tops"], x["place"])), F.lit(True))
        return F.when(at == 0, F.array_append(out, r)).otherwise(F.transform(out, lambda x, i: F.when(i + 1 == at, join(x, r)).otherwise(x)))

    def last_two(gs: Column, _: Column) -> Column:
        n = F.size(gs)
        return F.array_sort(F.array_append(F.slice(gs, F.lit(1), F.greatest(n - 2, F.lit(0))), join(F.element_at(gs, -2), F.element_at(gs, -1))))

    large = F.filter("gs", lambda x: -x["nf"] > small)
    ridden = F.array_sort(F.aggregate(F.filter("gs", lambda x: -x["nf"] <= small), large, ride))
    plans = plans.withColumn("gs", F.when(F.size("gs") > most, ridden).otherwise(F.col("gs")))
    rounds = F.when(F.size("gs") > most, F.sequence(F.lit(1), F.greatest(F.size("gs") - most, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    done = plans.select("plan", F.explode(F.aggregate(rounds, F.col("gs"), last_two)).alias("g"))
    return done.select("plan", F.explode("g.ids").alias("id"), F.col("g.id").alias("into"), (-F.col("g.nf")).alias("files"))


def hygiene(tracked: DataFrame, untracked: DataFrame, ignored: DataFrame) -> DataFrame:
    """what, n of three lists of paths: counts, and source files that are tracked though ignored."""
    count = lambda df, what: df.select("path").distinct().agg(F.count(F.lit(1)).alias("n")).select(F.lit(what).alias("what"), "n")
    both = tracked.join(ignored, "path", "left_semi")
    return count(tracked, "tracked").union(count(untracked, "untracked")).union(count(ignored, "ignored")).union(count(both, "tracked_but_ignored"))


def triage(findings: DataFrame, most: int = 5, snippet: int = 200) -> DataFrame:
    """The first findings to review, in order of file and line, with shortened snippets."""
    return findings.where("action = 'review'").orderBy("file", "line", "kind").limit(most).withColumn("snippet", F.substring("snippet", 1, snippet))


def is_conventional(message: Column) -> Column:
    return message.rlike(r"^(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(\([^)]+\))?!?: .+")


def symbol_counts(symbols: DataFrame) -> DataFrame:
    """kind, n, exported: how many symbols of each kind there are, and how many are exported."""
    return symbols.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("exported").cast("long")).alias("exported"))


# The family of a file by its ending.
FAMILIES = {
    "docs": (".md", ".rst", ".txt", ".adoc"),
    "config": (".yaml", ".yml", ".json", ".toml", ".ini", ".cfg", ".conf", ".env", ".hcl"),
    "script": (".sh", ".bash", ".zsh", ".ps1"),
    "code": (".go", ".py", ".rs", ".ts", ".tsx", ".js", ".jsx", ".java", ".rb", ".php", ".c", ".h", ".cpp"),
}
# How sure the wording of a family is before its scope and size.
FAMILY_CONFIDENCE = {"test": 0.7, "docs": 0.7, "config": 0.6, "script": 0.6, "code": 0.5}


def family(path: Column) -> Column:
    """test, docs, config, script, code or other."""
    out = F.lit("other")
    for name, endings in FAMILIES.items():
        out = F.when(extension(path).isin(*endings), name).otherwise(out)
    return F.when(is_test_file(path), "test").otherwise(out)


def polished(members: DataFrame, group: str) -> DataFrame:
    """group, files, family, scope, confidence: the family of more than half of a group's files, else other. members: group, path."""
    counts = members.groupBy(group, family(F.col("path")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.min(top_folder(F.col("path"))).alias("lo"), F.max(top_folder(F.col("path"))).alias("hi"))
    best = F.max(F.struct("n", "family"))
    whole = counts.groupBy(group).agg(F.sum("n").alias("files"), best.alias("b"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    own = F.when(2 * F.col("b.n") > F.col("files"), F.col("b.family")).otherwise("other")
    rows = whole.select(group, "files", own.alias("family"), F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("").alias("scope"))
    return rows.withColumn("confidence", group_confidence(F.col("family"), F.col("scope"), F.col("files"), FAMILY_CONFIDENCE))


def top_folder(path: Column) -> Column:
    """The first folder of a path; none for files in the root."""
    return F.when(F.contains(path, F.lit("/")), F.substring_index(path, "/", 1)).otherwise("")
