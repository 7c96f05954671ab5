"""Budgeted selection: prefix cut-off and the ordered passes that skip what doesn't fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrydeck.session import cut

from .joins import small


def running(df: DataFrame, order: list[str], cost: str, out: str = "used", parts: int = 64) -> DataFrame:
    """df with the running sum of ``cost`` in a total order, without bringing all rows into one task.

    Rows are ranged into parts by the first order column's quantiles; each part is summed on its
    own and moved up by the sums of the parts before it (at most ``parts`` rows, broadcast).
    """
    first = order[0].lstrip("-")
    sign = -1 if order[0].startswith("-") else 1
    lead = F.col(first) * sign
    cuts = df.agg(F.percentile_approx(lead, F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10 * parts).alias("c")).first()["c"]
    bucket = F.lit(0)
    for c in sorted(set(cuts or [])):
        bucket = bucket + (lead > c).cast("int")
    keys = [F.desc(o[1:]) if o.startswith("-") else F.asc(o) for o in order]
    placed = df.withColumn("_part", bucket)
    sums = placed.groupBy("_part").agg(F.sum(cost).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_part", "_before")
    own = F.sum(cost).over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    return placed.withColumn("_own", own).join(F.broadcast(before), "_part").withColumn(out, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def header_cutoff(df: DataFrame, order: list[str], cost: str, limit: int) -> DataFrame:
    """df with used (running cost) and shown: the rows before the first one whose running cost exceeds the limit."""
    return running(df, order, cost).withColumn("shown", F.col("used") <= limit)


def greedy(df: DataFrame, order: list[str], cost: str, limit: int, key: str) -> DataFrame:
    """key, taken, used: rows in order, each taken if it fits into what is left; a row that doesn't fit is skipped.

    Rows up to the first that doesn't fit are taken by a running sum; after it only rows that fit
    into what is left can be taken, and so on. Each pass reads the numbered (position, cost) table
    in parts; the driver holds where each pass ended and what was left. There are as many passes as
    rows that don't fit after the rows too large for what was left before them are set aside, which
    are few unless costs are made for it.
    """
    one = df.select(*[o.lstrip("-") for o in order], F.col(key).alias("_k"), F.col(cost).cast("long").alias("_c")).withColumn("_1", F.lit(1))
    rows = cut(running(one, order, "_1", "_n").select("_n", "_k", "_c"))
    start, left, passes = 0, limit, []
    while True:
        fits = running(rows.where((F.col("_n") > start) & (F.col("_c") <= left)), ["_n"], "_c", "_sum")
        got = fits.agg(F.min(F.when(F.col("_sum") > left, F.col("_n"))).alias("stop"), F.max(F.when(F.col("_sum") <= left, F.col("_sum"))).alias("spent")).first()
        passes.append((got["stop"], left))
        if got["stop"] is None:
            break
        start, left = got["stop"] - 1, left - (got["spent"] or 0)
    taken = F.lit(False)
    for stop, room in reversed(passes):
        fit = F.col("_c") <= room
        taken = fit if stop is None else F.when(F.col("_n") < stop, fit).otherwise(taken)
    marked = rows.withColumn("_taken", taken).withColumn("_spent", F.when(F.col("_taken"), F.col("_c")).otherwise(0))
    return running(marked, ["_n"], "_spent").select(F.col("_k").alias(key), F.col("_taken").alias("taken"), F.col("used").cast("long").alias("used"))


def enriched_cost(symbols: DataFrame) -> DataFrame:
    """path, cost, compact_cost: bytes of a file's exported symbols with and without signatures, receivers and docs."""
    size = lambda c: F.octet_length(F.coalesce(F.col(c), F.lit("")))
    method = F.when((F.col("kind") == "method") & (size("receiver") > 0), size("receiver") + 4).otherwise(0)
    doc = F.when(size("doc") > 0, size("doc") + 8).otherwise(0)
    full = 8 + size("name") + size("signature") + method + doc
    return symbols.where("exported").groupBy("path").agg(F.sum(full).cast("long").alias("cost"), F.sum(8 + size("name")).cast("long").alias("compact_cost"))


def detail_levels(files: DataFrame, max_tokens: int) -> DataFrame:
    """path, level of ranked files (path, rank, header, summary, cost): -1 left out, 0 path, 1 summary, 2 detail.

    Headers are cut off at 70 % of the budget; then files in rank order get a summary if it fits,
    and then, in the same order, detail if that fits in place of the summary.
    """
    budget = 4 * max_tokens
    shown = header_cutoff(files, ["rank"], "header", int(0.7 * budget)).select("path", "rank", "summary", "cost", "header", "shown")
    inside = shown.where("shown")
    base = inside.agg(F.coalesce(F.sum("header"), F.lit(0))).first()[0]
    one = greedy(inside.where("summary > 0"), ["rank"], "summary", budget - base, "path")
    got = inside.join(one.where("taken").select("path", F.lit(1).alias("level")), "path", "left").withColumn("level", F.coalesce("level", F.lit(0)))
    spent = base + (got.where("level = 1").agg(F.coalesce(F.sum("summary"), F.lit(0))).first()[0])
    more = greedy(got.where("level = 1").withColumn("extra", F.col("cost") - F.col("summary")), ["rank"], "extra", budget - spent, "path")
    done = got.join(more.where("taken").select("path", F.lit(2).alias("up")), "path", "left").select("path", "rank", F.coalesce("up", "level").alias("level"))
    return done.union(shown.where("not shown").select("path", "rank", F.lit(-1).alias("level")))


def promote_fields(levels: DataFrame, sizes: DataFrame, fields: DataFrame, max_tokens: int, most: int = 10) -> DataFrame:
    """levels (path, rank, level) with level 3 for the first ``most`` files in detail whose fields still fit, by rank; others that don't fit are passed over.

    sizes: path, header, summary, cost, by which what the levels use is summed up; fields: path,
    field_cost of the files that have fields. A file without fields stays as it is.
    """
    spent = F.when(F.col("level") >= 2, F.col("header") + F.col("cost")).when(F.col("level") == 1, F.col("header") + F.col("summary")).when(F.col("level") == 0, F.col("header")).otherwise(0)
    used = levels.join(sizes, "path").agg(F.coalesce(F.sum(spent), F.lit(0)).alias("u")).first()["u"]
    able = levels.where("level >= 2").join(fields, "path").select("path", "rank", "field_cost")
    taken = greedy(able, ["rank"], "field_cost", 4 * max_tokens - used, "path").where("taken").join(able.select("path", "rank"), "path")
    first = taken.orderBy("rank").limit(most).select("path", F.lit(3).alias("up"))
    return levels.join(F.broadcast(first), "path", "left").select("path", "rank", F.coalesce("up", "level").alias("level"))


def apply_overrides(levels: DataFrame, rules: DataFrame) -> DataFrame:
    """levels with the level that a rule (pattern, a regular expression, and level) forces on a path; the first pattern in byte order wins."""
    hit = levels.join(small(rules, 10_000), F.expr("path rlike pattern"), "left")
    forced: Column = F.min(F.when(F.col("pattern").isNotNull(), F.struct("pattern", F.col("forced"))))
    return hit.groupBy("path", "rank", "level").agg(forced.alias("f")).select("path", "rank", F.coalesce("f.forced", "level").alias("level"))
