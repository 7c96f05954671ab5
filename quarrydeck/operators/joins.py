"""Joins, counts and caps over import, reference and call tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrydeck.functions.classify import import_score, score_weight
from quarrydeck.session import cut, shuffled


def importer_counts(imports: DataFrame, key: str = "imp", importer: str = "path") -> DataFrame:
    """key, imported_by (distinct importing files), score."""
    n = imports.groupBy(key).agg(F.countDistinct(importer).alias("imported_by"))
    return n.withColumn("score", import_score(F.col("imported_by")).cast("long"))


def capped_sum(df: DataFrame, keys: list[str], value: Column, cap: int, out: str = "bonus") -> DataFrame:
    return df.groupBy(*keys).agg(F.least(F.sum(value), F.lit(cap)).cast("long").alias(out))


def symbol_bonus(symbols: DataFrame, path: str = "path", cap: int = 20) -> DataFrame:
    """The kinds' weights of a file's exported symbols, at most ``cap``."""
    return capped_sum(symbols.where("exported"), [path], score_weight(F.col("kind")), cap)


def prefix_rules(imports: DataFrame, rules: DataFrame, cap: int = 15) -> DataFrame:
    """path, labels (sorted, joined), bump: each label of the rules whose prefix an import begins with counts once; at most ``cap``.

    rules: label, prefix, bump; broadcast unless it is large.
    """
    hits = imports.join(small(rules), F.startswith(F.col("imp"), F.col("prefix"))).select("path", "label", "bump").distinct()
    labels = F.array_join(F.array_sort(F.collect_set("label")), ",")
    return hits.groupBy("path").agg(labels.alias("labels"), F.least(F.sum("bump"), F.lit(cap)).cast("long").alias("bump"))


def references(words: DataFrame, names: DataFrame, share: float | None = None) -> DataFrame:
    """path, name, refs: the other files that have an exported name among their words.

    words: path, word (distinct); names: path, name. Names that more than ``share`` of all files
    export are left out before the join, where that threshold is 2 or more: they say nothing and
    are its hot keys.
    """
    names = names.distinct()
    if share is not None:
        by_name = names.groupBy("name").agg(F.countDistinct("path").alias("_files"))
        total = words.agg(F.countDistinct("path").alias("_total"))
        common = by_name.join(F.broadcast(total)).where((F.floor(F.col("_total") * share) >= 2) & (F.col("_files") > F.floor(F.col("_total") * share))).select("name")
        names = names.join(shuffled(common), "name", "left_anti")
    by = words.select(F.col("path").alias("by"), F.col("word").alias("name"))
    return shuffled(names).join(by, "name").where(F.col("by") != F.col("path")).groupBy("path", "name").agg(F.countDistinct("by").alias("refs"))


def reference_bonus(refs: DataFrame, each: int = 2, cap: int = 24) -> DataFrame:
    return refs.groupBy("path").agg(F.least(F.sum("refs") * each, F.lit(cap)).cast("long").alias("bonus"))


def call_site_counts(calls: DataFrame, names: DataFrame) -> DataFrame:
    """path, callers: distinct other files that call an exported name, by its raw form, after its last dot, or without ()."""
    raw = F.col("name")
    plain = F.regexp_replace(raw, r"\(\)$", "")
    variants = F.array_distinct(F.array(raw, F.substring_index(raw, ".", -1), plain, F.substring_index(plain, ".", -1)))
    by = calls.select(F.col("path").alias("by"), F.explode(variants).alias("name")).distinct()
    return shuffled(names).join(by, "name").where(F.col("by") != F.col("path")).groupBy("path").agg(F.countDistinct("by").alias("callers"))


def orphans(exported: DataFrame, used: DataFrame, key: str) -> DataFrame:
    """Exported rows that nothing uses."""
    return exported.join(used.select(key).distinct(), key, "left_anti")


def divides(have: DataFrame, want: DataFrame, left: str, item: str) -> DataFrame:
    """The values of ``left`` that have every item of ``want`` (relational division)."""
    need = want.select(item).distinct()
    total = need.agg(F.count(F.lit(1)).alias("_need"))
    got = have.select(left, item).distinct().join(need, item).groupBy(left).agg(F.count(F.lit(1)).alias("_got"))
    return got.join(F.broadcast(total), F.col("_got") == F.col("_need")).select(left)


def within(points: DataFrame, spans: DataFrame, at: str, start: str, end: str, key: str, width: int) -> DataFrame:
    """points joined to the spans of the same key that hold them (start <= at <= end).

    Spans are dealt to buckets of ``width``, so that the join is on equal keys and buckets.
    """
    bucket = lambda c: F.floor(F.col(c) / width).cast("long")
    dealt = spans.withColumn("_bucket", F.explode(F.sequence(bucket(start), bucket(end))))
    p = points.withColumn("_bucket", bucket(at))
    return p.join(dealt, [key, "_bucket"]).where((F.col(at) >= F.col(start)) & (F.col(at) <= F.col(end))).drop("_bucket")


def capped_rows(df: DataFrame, group: list[str], order: list, cap: int) -> DataFrame:
    """The first ``cap`` rows of each group, with columns pos, total and truncated."""
    w = Window.partitionBy(*group)
    ranked = df.withColumn("pos", F.row_number().over(w.orderBy(*order)))
    totals = df.groupBy(*group).agg(F.count(F.lit(1)).alias("total"))
    return ranked.where(F.col("pos") <= cap).join(totals, group).withColumn("truncated", F.col("total") > cap)


def ownership(files: DataFrame, group: str, score: str, least: int = 2) -> DataFrame:
    """group, files, score: the groups of at least ``least`` files, with the sum of their scores."""
    return files.groupBy(group).agg(F.count(F.lit(1)).alias("files"), F.sum(score).alias("score")).where(F.col("files") >= least)


def coverage(files: DataFrame, group: str, tested: Column, penalty: Column) -> DataFrame:
    """group, files, tested, covered, penalty: how many files of a group are tested, whether any is, and what its files lose."""
    n = lambda c: F.sum(F.coalesce(c.cast("long"), F.lit(0)))
    return files.groupBy(group).agg(F.count(F.lit(1)).alias("files"), n(tested).alias("tested"), F.bool_or(F.coalesce(tested, F.lit(False))).alias("covered"), n(penalty).alias("penalty"))


def top_names(df: DataFrame, group: str, name: str, order: list, most: int) -> DataFrame:
    """group, top: the first ``most`` names of each group in an order, joined by commas."""
    top = df.withColumn("_pos", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_pos") <= most)
    return top.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", name))), lambda x: x[name]), ", ").alias("top"))


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, marked for a broadcast if it has ``most`` rows at most."""
    return F.broadcast(df) if df.count() <= most else df


def first_seen(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_pos", F.row_number().over(w)).where("_pos = 1").drop("_pos")


def mode(df: DataFrame, group: str, value: str, priority: Column | None = None) -> DataFrame:
    """The most frequent value of each group; ties to the smaller priority, then the smaller value."""
    p = F.lit(0) if priority is None else priority
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n")).withColumn("_p", p)
    w = Window.partitionBy(group).orderBy(F.desc("n"), "_p", value)
    return counts.withColumn("_pos", F.row_number().over(w)).where("_pos = 1").select(group, value, "n")


def find_ladder(symbols: DataFrame, name: str, kind: str | None = None, path: str | None = None) -> DataFrame:
    """Symbols by how well they match a name: 100 the same, 75 but for case, 50 a prefix, 25 contained but for case."""
    low = name.lower()
    match = (
        F.when(F.col("name") == name, 100)
        .when(F.lower("name") == low, 75)
        .when(F.startswith(F.col("name"), F.lit(name)), 50)
        .when(F.contains(F.lower("name"), F.lit(low)), 25)
    )
    out = symbols.withColumn("match", match).where("match is not null")
    if kind:
        out = out.where(F.lower("kind") == kind.lower())
    if path:
        out = out.where(F.contains(F.col("path"), F.lit(path)))
    return out


def ranked(df: DataFrame, order: list, out: str = "rank", limit: int | None = None) -> DataFrame:
    """Positions from 1 in a total order; with ``limit`` only the first rows are sorted out (a top-k).

    Without one, rows are dealt to tasks by ranges of the order, numbered there, and moved up by
    the numbers of rows in the ranges before (a row for each task).
    """
    if limit is not None:
        return df.orderBy(*order).limit(limit).withColumn(out, F.row_number().over(Window.orderBy(*order)))
    # which task has a row is fixed by the checkpoint
    placed = cut(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sizes = placed.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return placed.withColumn("_own", own).join(F.broadcast(before), "_range").withColumn(out, (F.col("_own") + F.col("_before")).cast("int")).select(*df.columns, out)


def adjacent_distinct(df: DataFrame, group: list[str], order: list, value: str) -> DataFrame:
    """The rows of each group, in an order, whose value isn't that of the row before."""
    before = F.lag(value).over(Window.partitionBy(*group).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*group).orderBy(*order)) == 1
    return df.withColumn("_same", ~first & F.col(value).eqNullSafe(before)).where(~F.col("_same")).drop("_same")


def uniform(df: DataFrame, group: str, value: str, out: str) -> DataFrame:
    """group, n, out: the value that all rows of a group have, null where they differ."""
    same = F.min(value).eqNullSafe(F.max(value)) & (F.count(value) == F.count(F.lit(1)))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.when(same, F.min(value)).alias(out))
