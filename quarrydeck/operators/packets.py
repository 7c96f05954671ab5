"""Packets of targets for many goals at once, each within a token budget, and reports with caps that say what they leave out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrydeck.functions.text import goal_tokens

#: Targets of a packet at most; variants of a target by falling size.
TARGETS = 6
VARIANTS = ("full", "primary", "identity", "minimum")
#: Goal terms up to which their table is broadcast; beyond, a shuffle join is used.
BROADCAST_TERMS = 200_000


def goal_terms(goals: DataFrame, goal: str = "goal", text: str = "text") -> DataFrame:
    """goal, term: the distinct tokens of each goal in plain words."""
    return goals.select(F.col(goal).alias("goal"), F.explode(F.array_distinct(goal_tokens(F.coalesce(F.col(text), F.lit(""))))).alias("term"))


def relevance(files: DataFrame, terms: DataFrame, fields: dict[str, int]) -> DataFrame:
    """goal, path, relevance: a goal's term that a field has as a token adds the field's weight. Files without any term make no row.

    Files' tokens meet the terms of all goals where they are read; if these are too many, their
    distinct terms, and only the tokens that some goal has go on.
    """
    few = terms.count() <= BROADCAST_TERMS
    known = terms.select("term").distinct()
    of = lambda f: F.transform(F.array_distinct(goal_tokens(F.coalesce(F.col(f), F.lit("")))), lambda t: F.struct(t.alias("term"), F.lit(fields[f]).alias("w")))
    tokens = files.select("path", F.inline_outer(F.concat(*[of(f) for f in fields]))).where("term is not null")
    if few:
        return tokens.join(F.broadcast(terms), "term").groupBy("goal", "path").agg(F.sum("w").cast("long").alias("relevance"))
    known = F.broadcast(known) if known.count() <= BROADCAST_TERMS else known
    mine = tokens.join(known, "term").groupBy("path", "term").agg(F.sum("w").alias("w"))
    return mine.join(terms, "term").groupBy("goal", "path").agg(F.sum("w").cast("long").alias("relevance"))


def first_rows(df: DataFrame, groups: list[str], order: list, most: int, pos: str = "pos") -> DataFrame:
    """The first ``most`` rows of each group with their position; tasks drop what can't be among them before rows move."""
    return df.withColumn(pos, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).where(F.col(pos) <= most)


def packets(candidates: DataFrame, budget: int, reserve: int = 0, targets: int = TARGETS) -> DataFrame:
    """One row per goal: goal, targets (pos, path, variant, cost, used), used, omissions (field, shown, total, reason).

    candidates: goal, path, relevance, score, costs (tokens of each variant, by falling size; null
    for one that the target hasn't). Targets come by relevance, score, path. Each takes its first
    variant that still fits the budget less the reserve; the first one of which none fits ends the
    packet. Omissions say which targets gave up a part and how many candidates came to nothing,
    and why: the limit of targets or the budget. A goal's packet is folded in one row of at most
    ``targets`` candidates; all goals go at once.
    """
    order = [F.desc("relevance"), F.desc("score"), "path"]
    totals = candidates.groupBy("goal").agg(F.count(F.lit(1)).alias("total"))
    best = first_rows(candidates.select("goal", "path", "relevance", "score", "costs"), ["goal"], order, targets)
    lists = best.groupBy("goal").agg(F.array_sort(F.collect_list(F.struct("pos", "path", "costs"))).alias("c"))
    free = budget - reserve
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(False).alias("full"), F.array().cast("array<struct<pos:int,path:string,variant:int,cost:bigint,used:bigint>>").alias("out"))

    def take(acc: Column, c: Column) -> Column:
        fits = F.array_position(F.transform(c["costs"], lambda x: F.coalesce(acc["used"] + x <= free, F.lit(False))), F.lit(True)).cast("int")
        cost = F.get(c["costs"], fits - 1).cast("long")
        more = F.struct((acc["used"] + cost).alias("used"), F.lit(False).alias("full"), F.array_append(acc["out"], F.struct(c["pos"].alias("pos"), c["path"].alias("path"), (fits - 1).alias("variant"), cost.alias("cost"), (acc["used"] + cost).alias("used"))).alias("out"))
        stop = F.struct(acc["used"].alias("used"), F.lit(True).alias("full"), acc["out"].alias("out"))
        return F.when(acc["full"] | (fits == 0), stop).otherwise(more)

    done = lists.join(totals, "goal").select("goal", "total", "c", F.aggregate("c", start, take).alias("p"))
    name = lambda v: F.element_at(F.array(*[F.lit(n) for n in VARIANTS]), v + 1)
    shown = F.size("p.out")
    cut_down = F.transform(F.filter("p.out", lambda t: t["variant"] > 0), lambda t: F.struct(F.format_string("targets[%s]", t["path"]).alias("field"), t["variant"].cast("long").alias("shown"), F.lit(len(VARIANTS)).cast("long").alias("total"), F.concat(F.lit("packed as "), name(t["variant"])).alias("reason")))
    why = F.when(F.col("p.full"), "token budget").otherwise("target limit")
    ended = F.array(F.struct(F.lit("targets").alias("field"), shown.cast("long").alias("shown"), F.col("total").alias("total"), why.alias("reason")))
    none = F.array().cast("array<struct<field:string,shown:bigint,total:bigint,reason:string>>")
    chosen = F.transform("p.out", lambda t: F.struct(t["pos"].alias("pos"), t["path"].alias("path"), name(t["variant"]).alias("variant"), t["cost"].alias("cost"), t["used"].alias("used")))
    return done.select("goal", chosen.alias("targets"), F.col("p.used").alias("used"), F.concat(cut_down, F.when(shown < F.col("total"), ended).otherwise(none)).alias("omissions"))


# How many hits reports show of a file, and of a kind.
FILE_CAP, KIND_CAP, KIND_CAPS = 12, 120, {"command": 80}


def kind_cap(kind: Column) -> Column:
    cap = F.lit(KIND_CAP)
    for k, n in KIND_CAPS.items():
        cap = F.when(kind == k, n).otherwise(cap)
    return cap


def capped(hits: DataFrame, caps: dict[str, tuple[list[str], int | Column, int]], order: list) -> DataFrame:
    """cap, key, pos and the columns of hits: what each cap shows. Every cap starts from all hits.

    caps: a name, and the columns of its groups, how many rows of a group it shows, and the most
    of these. Rows are taken in order; tasks drop what can't be shown before rows move.
    """
    out = None
    for name, (groups, cap, most) in caps.items():
        rows = first_rows(hits, groups, order, most).where(F.col("pos") <= cap)
        rows = rows.select(F.lit(name).alias("cap"), F.concat_ws("/", *groups).alias("key"), "pos", *hits.columns)
        out = rows if out is None else out.unionByName(rows)
    return out


def omitted(hits: DataFrame, caps: dict[str, tuple[list[str], int | Column, int]]) -> DataFrame:
    """cap, key, shown, total: the groups of which a cap leaves rows out."""
    out = None
    for name, (groups, cap, _) in caps.items():
        n = hits.groupBy(*groups).agg(F.count(F.lit(1)).alias("total"))
        shown = (F.lit(cap) if isinstance(cap, int) else cap).cast("long")
        rows = n.select(F.lit(name).alias("cap"), F.concat_ws("/", *groups).alias("key"), shown.alias("shown"), "total").where("total > shown")
        out = rows if out is None else out.unionByName(rows)
    return out


def report_caps() -> dict[str, tuple[list[str], int | Column, int]]:
    """The caps of the reports of surfaces and effects: hits of a file, of a kind, and of a lane."""
    return {"files": (["path"], FILE_CAP, FILE_CAP), "kinds": (["kind"], kind_cap(F.col("kind")), KIND_CAP), "lanes": (["lane"], KIND_CAP, KIND_CAP)}
