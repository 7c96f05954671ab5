"""Scores by component, BM25 for a goal, task relevance and the ordered passes after ranking."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from quarrydeck.functions.classify import TIERS, lookup
from quarrydeck.functions.text import goal_tokens, token_count
from quarrydeck.session import cut

K1, B = 1.2, 0.75


def component_rows(df: DataFrame, key: str, parts: dict[str, Column]) -> DataFrame:
    """key, component, value of the components that aren't zero: the explainable form of a score."""
    rows = F.array(*[F.struct(F.lit(k).alias("component"), v.cast("long").alias("value")) for k, v in parts.items()])
    return df.select(key, F.explode(rows).alias("c")).select(key, "c.component", "c.value").where("value <> 0")


def tier_rollup(components: DataFrame, key: str) -> DataFrame:
    """key, tier, total of the tiers that aren't zero."""
    tier = lookup(TIERS, F.col("component"), "structural").alias("tier")
    return components.groupBy(key, tier).agg(F.sum("value").alias("total")).where("total <> 0")


def postings(tokens: DataFrame) -> DataFrame:
    """path, term, tf from rows of path, term, weight."""
    return tokens.groupBy("path", "term").agg(F.sum("weight").alias("tf"))


def term_counts(files: DataFrame, content: str = "content") -> DataFrame:
    """term, df (files that have it), tf of the goal tokens of all files; only one row for each term and task is shuffled. Each file is one row."""
    tokens = files.select(goal_tokens(F.col(content)).alias("ts"))
    both = tokens.select(F.posexplode(F.array("ts", F.array_distinct("ts"))).alias("once", "ts")).select("once", F.explode("ts").alias("term"))
    return both.groupBy("term").agg(F.sum("once").cast("long").alias("df"), F.sum(1.0 - F.col("once")).alias("tf"))


def corpus_stats(post: DataFrame) -> DataFrame:
    """One row: n_docs, avgdl."""
    dl = post.groupBy("path").agg(F.sum("tf").alias("dl"))
    return dl.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avgdl"))


def _like(term: str) -> Column:
    """How a posting's term answers a goal term: 3 the same, 2 its plural, 1 its singular, 0 the same four first letters, else null."""
    c = F.col("term")
    out = F.when(c == term, 3).when(c == term + "s", 2)
    if term.endswith("s"):
        out = out.when(c == term[:-1], 1)
    if len(term) >= 4:
        out = out.when((F.length(c) >= 4) & (F.substring(c, 1, 4) == term[:4]), 0)
    return out


def goal_table(post: DataFrame, terms: list[str], exact: bool = False) -> DataFrame:
    """path, dl and, for each goal term, w0, w1, ... (its weighted tf, null if none) and e0, e1, ... (its own tf), in one aggregate.

    The weighted tf is the tf of the term, or 0.9 of its plural's or singular's, or the best 0.6
    of a term with the same four first letters.
    """
    columns = [F.sum("tf").alias("dl")]
    for i, t in enumerate(terms):
        own = F.max(F.when(F.col("term") == t, F.col("tf").cast("double")))
        value = F.when(_like(t) == 3, F.col("tf")).when(_like(t) > 0, 0.9 * F.col("tf")).otherwise(0.6 * F.col("tf")).cast("double")
        best = own if exact else F.max(F.when(_like(t).isNotNull(), F.struct(_like(t).alias("like"), value.alias("wtf"))))["wtf"]
        columns += [best.alias(f"w{i}"), own.alias(f"e{i}")]
    return post.groupBy("path").agg(*columns)


def goal_counts(files: DataFrame, terms: list[str], content: str = "content") -> DataFrame:
    """goal_table with exact terms, straight from whole texts: each row counts its own tokens, and nothing is shuffled."""
    text = F.col(content)
    tf = lambda t: F.nullif(token_count(text, t), F.lit(0)).cast("double")
    counted = files.select("path", token_count(text).cast("double").alias("dl"), *[tf(t).alias(f"w{i}") for i, t in enumerate(terms)])
    return counted.select("*", *[F.col(f"w{i}").alias(f"e{i}") for i in range(len(terms))])


def bm25_scores(table: DataFrame, terms: list[str], pairs: bool = False) -> DataFrame:
    """path, bm25 of the rows of a goal table (goal_table or goal_counts) that match any term; with ``pairs`` a bonus for each pair of neighbouring terms that both match.

    The table has a few numbers a file; it is checkpointed, as the corpus' statistics come first.
    """
    if not terms:
        return table.sparkSession.createDataFrame([], "path string, bm25 double")
    # filtered after the checkpoint: a filter before it would be pushed down, and count all tokens twice
    table = cut(table).where("dl > 0")
    stats = table.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avg"), *[F.count(f"e{i}").alias(f"df{i}") for i in range(len(terms))]).first()
    n, avg = stats["n"], stats["avg"] or 1.0
    weight = [F.lit(math.log((n - stats[f"df{i}"] + 0.5) / (stats[f"df{i}"] + 0.5) + 1)) for i in range(len(terms))]
    part = lambda i: F.col(f"w{i}") * (K1 + 1) / (F.col(f"w{i}") + K1 * (1 - B + B * F.col("dl") / avg)) * weight[i]
    total = sum((F.coalesce(F.when(F.col(f"w{i}") > 0, part(i)), F.lit(0.0)) for i in range(len(terms))), F.lit(0.0))
    if pairs:
        for i in range(len(terms) - 1):
            both = (F.col(f"w{i}") > 0) & (F.col(f"w{i + 1}") > 0)
            total = total + F.when(both, F.greatest((weight[i] + weight[i + 1]) / 2, F.lit(1.5))).otherwise(0.0)
    return table.where(F.greatest(*[F.col(f"w{i}") for i in range(len(terms))], F.lit(0.0)) > 0).select("path", total.alias("bm25"))


def bm25(post: DataFrame, terms: list[str], exact: bool = False) -> DataFrame:
    """path, bm25 of the files whose postings match any term: the terms' scores and, unless ``exact``, near terms and the bonus for pairs."""
    return bm25_scores(goal_table(post, terms, exact), terms, pairs=not exact)


def matching(post: DataFrame, terms: list[str]) -> DataFrame:
    """path of the files that match any of the terms, near ones included."""
    near = F.coalesce(*[_like(t) for t in terms])
    return post.where(near.isNotNull() & (F.col("tf") > 0)).select("path").distinct()


def with_intent(ranked: DataFrame, scores: DataFrame, negated: DataFrame | None = None) -> DataFrame:
    """ranked (path, score) after the goal: score + trunc(score * boost), boost the share of the largest bm25, a tenth for files with a negated term."""
    top = F.broadcast(scores.agg(F.max("bm25").alias("top")))
    out = ranked.join(scores, "path", "left").join(top).withColumn("boost", F.when(F.col("top") > 0, F.coalesce(F.col("bm25") / F.col("top"), F.lit(0.0))).otherwise(0.0))
    if negated is not None:
        out = out.join(negated.select("path", F.lit(True).alias("neg")).distinct(), "path", "left").withColumn("boost", F.when(F.col("neg"), F.col("boost") * 0.1).otherwise(F.col("boost"))).drop("neg")
    after = (F.col("score") * (1 + F.col("boost"))).cast("long")
    return out.withColumn("intent", after - F.col("score")).withColumn("score", after).drop("top", "bm25")


def consumed_rerank(ranked: DataFrame, consumed: DataFrame, deps: DataFrame, each: int = 15, cap: int = 45) -> DataFrame:
    """Consumed files keep half their score (toward zero); importers of consumed files gain ``each`` for every one, at most ``cap``.

    ranked: path, score; consumed: path; deps: path (importer), dep.
    """
    mark = consumed.select("path").distinct().withColumn("consumed", F.lit(True))
    gain = deps.select("path", "dep").distinct().join(mark.select(F.col("path").alias("dep")), "dep").groupBy("path").agg(F.least(F.count(F.lit(1)) * each, F.lit(cap)).cast("long").alias("gain"))
    half = F.when(F.col("consumed"), F.expr("score div 2")).otherwise(F.col("score"))
    return ranked.join(mark, "path", "left").join(gain, "path", "left").select("path", F.col("score").alias("before"), F.coalesce("consumed", F.lit(False)).alias("consumed"), (half + F.coalesce("gain", F.lit(0))).cast("long").alias("score"))


def task_relevance(df: DataFrame, key: str, fields: dict[str, int], terms: list[str]) -> DataFrame:
    """key, relevance: each term that a field contains (but for case) adds the field's weight."""
    total = F.lit(0)
    for name, weight in fields.items():
        low = F.lower(F.coalesce(F.col(name), F.lit("")))
        for t in terms:
            total = total + F.when(F.contains(low, F.lit(t)), weight).otherwise(0)
    return df.select(key, total.cast("long").alias("relevance")).where("relevance > 0")
