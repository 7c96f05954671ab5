"""The audit brief: what to read first, the ranges around hits, the lanes of a review, and hints of effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from quarrydeck.functions.classify import is_test_file, lookup

from . import audit

# Lines before and after a hit that are read with it, and the lines of a range at most.
BEFORE, AFTER, LONGEST = 2, 24, 80
#: What a group of the queue shows at most; totals of the whole are kept beside it.
MOST_FILES, MOST_RANGES, MOST_REASONS, MOST_EFFECTS = 12, 8, 4, 12

# The groups of the queue in their order, with their lanes.
GROUPS = {
    "user-surface": "cli-ux",
    "writes-and-persistence": "data-integrity",
    "network-and-api-effects": "api-contracts",
    "subprocess-and-exit": "error-handling",
    "dependency-policy": "dependency-policy",
    "config-surface": "config",
    "secret-and-crypto": "security",
    "lifecycle-concurrency": "lifecycle-concurrency",
    "resource-bounds": "performance",
    "test-risk": "test-risk",
    "coupling-hotspots": "coupling",
    "dead-export-surface": "dead-code",
    "parse-fidelity": "parse-fidelity",
    "ranked-risk-packets": "architecture",
    "state-and-time": "data-integrity",
    "api-schema": "api-contracts",
}
# The group that a kind of surface, a kind of effect and a lane of risks belong to.
SURFACE_GROUP = {
    "command": "user-surface", "flag": "user-surface", "output": "user-surface", "env-var": "config-surface", "config-key": "config-surface",
    "route": "api-schema", "schema-field": "api-schema", "dependency-manifest": "dependency-policy",
}
EFFECT_GROUP = {
    "filesystem-write": "writes-and-persistence", "database": "writes-and-persistence", "http": "network-and-api-effects", "serialization": "network-and-api-effects",
    "subprocess": "subprocess-and-exit", "process-exit": "subprocess-and-exit", "secret": "secret-and-crypto", "crypto": "secret-and-crypto", "randomness": "secret-and-crypto",
    "time": "state-and-time", "filesystem-read": "state-and-time", "context-background": "lifecycle-concurrency", "goroutine": "lifecycle-concurrency", "unbounded-read": "resource-bounds",
}
RISK_GROUP = {"test-risk": "test-risk", "dead-code": "dead-export-surface", "coupling": "coupling-hotspots", "parse-fidelity": "parse-fidelity"}
# Names of manifests in the root folder.
MANIFESTS = ("go.mod", "package.json", "composer.json", "Cargo.toml", "pyproject.toml", "Gemfile")

#: Why a lane is reviewed.
LANE_REASON = {
    "api-contracts": "handlers and schemas are promises to callers",
    "architecture": "many files lean on these",
    "cli-ux": "users see and type this",
    "config": "settings change behaviour without a build",
    "data-integrity": "what is stored may be lost or spoilt",
    "dead-code": "nothing in the corpus imports these exports",
    "coupling": "these depend on many others",
    "dependency-policy": "foreign code comes in here",
    "error-handling": "failures end or leave the process here",
    "large-functions": "long bodies hide faults",
    "lifecycle-concurrency": "something may outlive its caller",
    "parse-fidelity": "these were read by line patterns only",
    "performance": "input of any size is held",
    "security": "secrets, keys or chance are handled",
    "test-risk": "exports without a test beside them",
}
#: Lanes whose signal can't see callers and tests outside the corpus.
CAVEAT = {"dead-code": "callers outside the corpus aren't seen", "test-risk": "tests outside the corpus aren't seen"}


def lane_reason(lane: Column) -> Column:
    return lookup(LANE_REASON, lane, "a signal of rank or boundary")


def read_range(line: Column, last: Column | None = None) -> Column:
    """start, end of the lines to read around a hit, or from it to a last line; never before line 1, 80 lines at most."""
    at = F.greatest(line, F.lit(1))
    start = F.greatest(at - BEFORE, F.lit(1))
    end = at + AFTER if last is None else F.greatest(last, at) + AFTER
    return F.struct(start.cast("int").alias("start"), F.least(end, start + LONGEST - 1).cast("int").alias("end"))


def manifest_hits(files: DataFrame) -> DataFrame:
    """path, line, kind, lane, weight, name: the manifests in the root folder, as surface."""
    found = files.where(F.col("path").isin(*MANIFESTS)).select("path").distinct()
    return found.select("path", F.lit(0).alias("line"), F.lit("dependency-manifest").alias("kind"), F.lit("dependency-policy").alias("lane"), F.lit(15).alias("weight"), F.col("path").alias("name"))


def effect_ranges(effects: DataFrame, scores: DataFrame) -> DataFrame:
    """kind, path, line, score: of every file of a kind, all its first effects (12 at most), whatever their kind.

    effects: path, line, kind, pattern (see audit.scan); scores: path, score.
    """
    w = Window.partitionBy("path").orderBy("line", "pattern")
    first = effects.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= MOST_EFFECTS).select("path", "line", "pos")
    return effects.select("kind", "path").distinct().join(first, "path").join(scores.select("path", "score"), "path")


def read_queue(risks: DataFrame, surface: DataFrame, effects: DataFrame, ranked: DataFrame) -> DataFrame:
    """priority, group, lane, files, n_files, ranges, n_ranges, reasons, caveat: one row for each group that has files.

    risks: path, rule, lane, points; surface and effects: path, line, kind, lane, weight (effects also
    pattern); ranked: path, score. Lists are in the order in which the sources name their items and
    hold the first of them; n_files and n_ranges count all. Test files are left out. Items are
    first grouped by themselves, so that a group that holds most of them is no task's alone.
    """
    order = lambda step, key, path, line: F.struct(step.cast("int").alias("step"), key.cast("long").alias("key"), path.alias("path"), line.cast("int").alias("line"))
    path, zero = F.col("path"), F.lit(0)
    item = lambda df, group, reason, at, line=None: df.select(group.alias("group"), reason.alias("reason"), "path", (F.lit(None).cast("int") if line is None else line.cast("int")).alias("line"), at.alias("at")).where("group is not null")

    points = risks.groupBy("path").agg(F.sum("points").alias("points"))
    top = item(points, F.lit("ranked-risk-packets"), F.lit("highest sums of points"), order(F.lit(0), -F.col("points"), path, zero))
    by_lane = item(risks.select("path", "lane").distinct(), lookup(RISK_GROUP, F.col("lane"), None), lane_reason(F.col("lane")), order(F.lit(1), zero, path, zero))
    steps = {k: 2 + i for i, k in enumerate(SURFACE_GROUP)}
    shown = item(surface, lookup(SURFACE_GROUP, F.col("kind"), None), lookup({k: LANE_REASON[GROUPS[g]] for k, g in SURFACE_GROUP.items()}, F.col("kind"), None), order(lookup(steps, F.col("kind"), 0), zero, path, F.col("line")), F.col("line"))
    turns = {k: 20 + i for i, k in enumerate(sorted(EFFECT_GROUP))}
    turn, of, why = (lookup(t, F.col("kind"), None) for t in (turns, EFFECT_GROUP, {k: LANE_REASON[GROUPS[g]] for k, g in EFFECT_GROUP.items()}))
    does = item(effects.select("kind", "path").distinct(), of, why, order(turn, zero, path, zero))
    items = top.union(by_lane).union(shown).union(does).where(~is_test_file(path))
    ranges = effect_ranges(effects, audit.file_scores(effects, ranked))
    near = shown.union(item(ranges, of, why, order(turn, -F.col("score"), path, F.col("pos")), F.col("line"))).where(~is_test_file(path))
    spans = near.select("group", "path", "reason", "at", read_range(F.col("line")).alias("r")).select("group", "path", "reason", "at", "r.start", "r.end")

    def first(df: DataFrame, keys: list[str], most: int, out: str, count: str) -> DataFrame:
        own = df.groupBy("group", *keys).agg(F.min("at").alias("at"))
        totals = own.groupBy("group").agg(F.count(F.lit(1)).alias(count))
        kept = own.withColumn("pos", F.row_number().over(Window.partitionBy("group").orderBy("at", *keys))).where(F.col("pos") <= most)
        value = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
        listed = kept.groupBy("group").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", value.alias("v")))), lambda x: x["v"]).alias(out))
        return totals.join(listed, "group")

    reasons = items.groupBy("group").agg(F.slice(F.array_sort(F.collect_set("reason")), 1, MOST_REASONS).alias("reasons"))
    out = first(items, ["path"], MOST_FILES, "files", "n_files").join(reasons, "group").join(first(spans, ["path", "start", "end", "reason"], MOST_RANGES, "ranges", "n_ranges"), "group", "left")
    lane = lookup(GROUPS, F.col("group"), "")
    priority = lookup({g: i for i, g in enumerate(GROUPS)}, F.col("group"), None)
    return out.fillna(0, ["n_ranges"]).select(priority.cast("int").alias("priority"), "group", lane.alias("lane"), "files", "n_files", "ranges", "n_ranges", "reasons", lookup(CAVEAT, lane, "").alias("caveat"))


def review_lanes(queue: DataFrame) -> DataFrame:
    """lane, files, n_files, why, text, caveat: the queue by lanes, each file where the first group names it. queue: see read_queue."""
    rows = queue.select("lane", "priority", F.posexplode("files").alias("pos", "path"))
    own = rows.groupBy("lane", "path").agg(F.min(F.struct("priority", "pos")).alias("at"))
    files = own.groupBy("lane").agg(F.count(F.lit(1)).alias("n_files"), F.slice(F.transform(F.array_sort(F.collect_list(F.struct("at", "path"))), lambda x: x["path"]), 1, MOST_FILES).alias("files"))
    why = queue.select("lane", F.explode("reasons").alias("reason")).groupBy("lane").agg(F.slice(F.array_sort(F.collect_set("reason")), 1, MOST_REASONS).alias("why"))
    return files.join(why, "lane").select("lane", "files", "n_files", "why", lane_reason(F.col("lane")).alias("text"), lookup(CAVEAT, F.col("lane"), "").alias("caveat"))


# Endings of called names and marks in lines that hint at an effect: kind, lane.
CALL_HINTS = {"(fetch|axios)$|http[.]": ("http", "api-contracts"), "mail$": ("external-message", "data-integrity"), "(file_put_contents|writefile)$": ("filesystem-write", "data-integrity")}
LINE_HINTS = {"fetch(": ("http", "api-contracts"), "mail(": ("external-message", "data-integrity"), "file_put_contents(": ("filesystem-write", "data-integrity")}


def effect_hints(calls: DataFrame, lines: DataFrame) -> DataFrame:
    """path, line, kind, lane, op, source of what calls (path, name, line) and lines (path, line, text) hint at, each once."""

    def first(cases: list[tuple[Column, tuple[str, str], Column]]) -> Column:
        out = F.lit(None)
        for found, (kind, lane), op in reversed(cases):
            out = F.when(found, F.struct(F.lit(kind).alias("kind"), F.lit(lane).alias("lane"), op.alias("op"))).otherwise(out)
        return out

    called = first([(F.lower("name").rlike(rx), what, F.col("name")) for rx, what in CALL_HINTS.items()])
    marked = first([(F.contains(F.lower("text"), F.lit(mark)), what, F.lit(mark.rstrip("("))) for mark, what in LINE_HINTS.items()])
    a = calls.select("path", "line", called.alias("h"), F.lit("call").alias("source"))
    b = lines.select("path", "line", marked.alias("h"), F.lit("line").alias("source"))
    return a.union(b).where("h is not null").select("path", "line", "h.kind", "h.lane", "h.op", "source").distinct()
