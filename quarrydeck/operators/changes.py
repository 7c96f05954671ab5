"""Analysis of change sets: co-change, weighted pairs, clusters, symbol deltas and dependency bumps."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quarrydeck.functions.classify import commit_confidence
from quarrydeck.session import cut, shuffled, ship_code

from .components import components

# What connects two changed files, and how strongly.
WEIGHTS = {"test-pair": 1.0, "symbol-dep": 0.8, "co-change": 0.5, "sibling": 0.3}
THRESHOLD = 0.75
#: Co-change: blocks of items at least, items of one block, and tasks that the cells of two blocks are dealt to at most.
BLOCKS, BLOCK_ITEMS, CELL_TASKS = 8, 4000, 2000
#: Items of sets that a task keeps before it counts their pairs, and pairs, or counts, that it looks at together.
KEPT, CELLS = 2_000_000, 250_000


def co_change(changes: DataFrame, group: str, item: str, least: int = 3, most: int | None = None) -> DataFrame:
    """a, b, n (a < b): how many change sets hold both items; at least ``least``.

    Items are distinct per change set; ``most``, where given, leaves out change sets with more items
    (mass edits say nothing). The pairs grow with the square of the sets, as they do in the result, so
    they never move: items are dealt to blocks, each cell of two blocks gets its items of every set,
    and all pairs of a cell are counted where it lies, in a table of one number for each two items.
    """
    own = changes.select(group, item)
    if most is not None:
        sizes = own.groupBy(group).agg(F.countDistinct(item).alias("_n")).where(F.col("_n") <= most)
        own = own.join(shuffled(sizes.select(F.col(group).alias("_g"))), F.col(group).eqNullSafe(F.col("_g"))).drop("_g")
    n = own.agg(F.approx_count_distinct(item)).first()[0]
    blocks = max(BLOCKS, -(-n // BLOCK_ITEMS))
    block = F.pmod(F.xxhash64(item), F.lit(blocks))
    held = own.groupBy(group, block.alias("b")).agg(F.collect_set(item).alias("items"))
    sent = held.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("cell", F.least("b", "o") * blocks + F.greatest("b", "o"))
    cells = sent.repartition(min(blocks * (blocks + 1) // 2, CELL_TASKS), "cell")
    side = lambda mine: F.first(F.when(mine, F.col("items")), ignorenulls=True)
    met = cells.groupBy("cell", group).agg(side(F.col("b") <= F.col("o")).alias("x"), side(F.col("b") >= F.col("o")).alias("y"))
    kind = changes.schema[item].dataType
    ship_code(changes.sparkSession)
    rows = met.where("x is not null and y is not null").select("cell", (F.floor(F.col("cell") / blocks) == F.col("cell") % blocks).alias("one"), "x", "y")
    counts = rows.sortWithinPartitions("cell").mapInArrow(_counted(least), StructType([StructField("u", kind), StructField("n", LongType()), StructField("y", ArrayType(kind))]))
    return counts.select("u", "n", F.explode("y").alias("v")).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"), "n")


def _counted(least: int):
    """Batches of cell, one (both blocks are the same), x, y, sorted by cell, to u, n, y: the items that are n times together with u, at least ``least``."""

    def run(batches):
        last, cell = None, None
        for b in batches:
            at = b["cell"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(at)) + 1), len(at)]
            for k, end in itertools.pairwise(cuts):
                if k == end:
                    continue
                if at[k] != last:
                    if cell is not None:
                        yield from cell.pairs(least)
                    last, cell = at[k], _Cell(b["one"][int(k)].as_py())
                cell.add(b["x"].slice(k, end - k), b["y"].slice(k, end - k))
        if cell is not None:
            yield from cell.pairs(least)

    return run


class _Cell:
    """How often each item of one block is with each of another (or the same one), in a table of counts."""

    def __init__(self, one: bool):
        self.one, self.known, self.table, self.kept, self.values = one, [None, None], np.zeros((0, 0), np.int32), [], 0

    def _numbers(self, side: int, lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the items of a side, and how many each row has."""
        items = lists.flatten()
        known = items.slice(0, 0) if self.known[side] is None else self.known[side]
        found = pc.index_in(items, known)
        if found.null_count:
            known = pa.concat_arrays([known, items.filter(found.is_null()).unique()])
            found = pc.index_in(items, known)
        self.known[side] = known
        return found.to_numpy().astype(np.int64), pc.list_value_length(lists).to_numpy().astype(np.int64)

    def add(self, x: pa.Array, y: pa.Array) -> None:
        u = self._numbers(0, x)
        if self.one:
            self.known[1] = self.known[0]
        self.kept.append((*u, *(u if self.one else self._numbers(1, y))))
        self.values += len(self.kept[-1][0]) + len(self.kept[-1][2])
        if self.values >= KEPT:
            self.fold()

    def fold(self) -> None:
        """Count the pairs of the sets that are kept: those of a few items at a time, so that their counts lie close together."""
        if not self.kept:
            return
        u, some_u, v, some_v = (np.concatenate(c) for c in zip(*self.kept, strict=True))
        self.kept, self.values = [], 0
        need = [len(k) for k in self.known]
        if need[0] > self.table.shape[0] or need[1] > self.table.shape[1]:
            table = np.zeros([max(n, old) for n, old in zip(need, self.table.shape, strict=True)], np.int32)
            table[: self.table.shape[0], : self.table.shape[1]] = self.table
            self.table = table
        order = np.argsort(u, kind="stable")
        row, u = np.repeat(np.arange(len(some_u)), some_u)[order], u[order]
        each, at_v, first = some_v[row], (np.cumsum(some_v) - some_v)[row], np.searchsorted(u, np.arange(need[0] + 1))
        pairs, width, k = np.concatenate([[0], np.cumsum(each)]), need[1], 0
        while k < need[0] and width:
            end = min(k + max(1, CELLS // width), max(k + 1, int(np.searchsorted(pairs[first], pairs[first[k]] + CELLS, "right")) - 1), need[0])
            a, b = first[k], first[end]
            at = np.repeat(at_v[a:b] - pairs[a:b] + pairs[a], each[a:b]) + np.arange(pairs[b] - pairs[a])
            cell = np.repeat((u[a:b] - k) * width, each[a:b]) + v[at]
            self.table[k:end, :width] += np.bincount(cell, minlength=(end - k) * width).reshape(end - k, width).astype(np.int32)
            k = end

    def pairs(self, least: int):
        self.fold()
        table = self.table[: len(self.known[0]), : len(self.known[1])]
        width = max(table.shape[1], 1)
        some = max(1, 50_000 // width)
        for k in range(0, len(table), some):
            part = table[k : k + some]
            enough = part >= max(least, 1)
            if self.one:
                enough &= np.arange(table.shape[1]) > np.arange(k, k + len(part))[:, None]
            at = np.flatnonzero(enough)
            if not len(at):
                continue
            i, n = at // width, part.reshape(-1)[at].astype(np.int64)
            key = i * (n.max() + 1) + n
            order = np.argsort(key.astype(np.uint16) if key.max() < 1 << 16 else key, kind="stable")
            key = key[order]
            first = np.flatnonzero(np.diff(key, prepend=-1))
            made = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)), pa.int32()), self.known[1].take(pa.array((at - i * width)[order])))
            yield pa.record_batch([self.known[0].take(pa.array(i[order[first]] + k)), pa.array(n[order[first]]), made], ["u", "n", "y"])


def _stars(rows: DataFrame, node: str) -> DataFrame:
    """src, dst: each node of a pair of change sets (g, h) with the pair's least one."""
    least = rows.groupBy("g", "h").agg(F.min(node).alias("dst"))
    return rows.join(shuffled(least), ["g", "h"]).where(F.col(node) != F.col("dst")).select(F.col(node).alias("src"), "dst").distinct()


def co_components(changes: DataFrame, group: str, item: str) -> DataFrame:
    """node, component (its smallest node): what pairs of items join that two change sets or more hold, without making those pairs.

    All items of the same two sets are linked with each other, so each may be linked with the least
    of them alone. First every item shows the pairs of its neighbouring sets; then the items outside
    the largest component show all pairs of their sets, and meet all that have one of these. Items
    without a link make no row; null items and sets are left out.
    """
    own = changes.where(F.col(group).isNotNull() & F.col(item).isNotNull())
    sets = cut(own.groupBy(F.col(item).cast("long").alias("node")).agg(F.array_sort(F.collect_set(group)).alias("gs")).where("size(gs) > 1"))
    near = sets.select("node", F.explode(F.arrays_zip(F.expr("slice(gs, 1, size(gs) - 1)").alias("g"), F.expr("slice(gs, 2, size(gs) - 1)").alias("h"))).alias("p")).select("node", "p.g", "p.h")
    found = components(_stars(near, "node"))
    known = cut(sets.join(shuffled(found), "node", "left").select("node", "gs", F.coalesce("component", "node").alias("component")))
    largest = known.groupBy("component").count().orderBy(F.desc("count"), "component").first()
    if largest is None:
        return known.select("node", "component")

    def every(rows: DataFrame) -> DataFrame:
        firsts = rows.select("component", "gs", F.posexplode("gs").alias("i", "g"))
        return firsts.select("component", "g", F.explode(F.slice("gs", F.col("i") + 2, F.size("gs"))).alias("h")).distinct()

    outside = known.where(F.col("component") != largest["component"])
    if not outside.isEmpty():
        few = cut(every(outside))
        inside = every(known.where(F.col("component") == largest["component"])).join(shuffled(few.select("g", "h").distinct()), ["g", "h"], "left_semi")
        over = components(_stars(few.unionByName(inside), "component")).select(F.col("node").alias("component"), F.col("component").alias("to"))
        known = known.join(shuffled(over), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    sizes = known.groupBy("component").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return known.join(shuffled(sizes), "component").select("node", "component")


def combined(edges: DataFrame) -> DataFrame:
    """a, b, weight, reason: the strongest edge of each pair; ties to the smaller reason. Ends are put in order."""
    e = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "weight", "reason").where("a <> b")
    top = e.groupBy("a", "b").agg(F.max("weight").alias("weight"))
    return e.join(top, ["a", "b", "weight"]).groupBy("a", "b", "weight").agg(F.min("reason").alias("reason"))


def clusters(nodes: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, component (its smallest node): what edges of at least the threshold join; other nodes stand alone."""
    strong = edges.where(F.col("weight") >= threshold).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    found = components(strong)
    return nodes.select("node").distinct().join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def cluster_facts(members: DataFrame, edges: DataFrame) -> DataFrame:
    """component, files, types, confidence of clusters. members: component, node, type; edges: a, b, weight."""
    strong = edges.where("weight > 0.3").join(members.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.lit(True).alias("strong"))
    facts = members.groupBy("component").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("type").alias("types")).join(strong, "component", "left")
    return facts.select("component", "files", "types", F.round(commit_confidence(F.col("types"), F.col("files"), F.coalesce("strong", F.lit(False))), 2).alias("confidence"))


def delta(pre: DataFrame, post: DataFrame, key: list[str], name: str, value: str) -> DataFrame:
    """key, name, change (added, removed or modified), breaking, by a full outer join on name.

    pre and post: key, name, value, exported. Breaking: an exported one goes, or changes while exported on both sides.
    """
    a = pre.select(*key, name, F.col(value).alias("old"), F.col("exported").alias("was"))
    b = post.select(*key, name, F.col(value).alias("new"), F.col("exported").alias("is_now"))
    both = a.join(b, [*key, name], "full_outer")
    change = F.when(F.col("was").isNull(), "added").when(F.col("is_now").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    breaking = F.when(change == "removed", F.col("was")).when(change == "modified", F.col("was") & F.col("is_now")).otherwise(F.lit(False))
    return both.withColumn("change", change).withColumn("breaking", breaking).where("change is not null").select(*key, name, "change", "breaking")


def dependency_bumps(diff: DataFrame) -> DataFrame:
    """path, name, action (bump, drop or add), old, new of a diff's lines: path, sign (- or +), name, version."""
    minus = diff.where("sign = '-'").select("path", "name", F.col("version").alias("old")).dropDuplicates(["path", "name"])
    plus = diff.where("sign = '+'").select("path", "name", F.col("version").alias("new")).dropDuplicates(["path", "name"])
    both = minus.join(plus, ["path", "name"], "full_outer")
    action = F.when(F.col("new").isNull(), "drop").when(F.col("old").isNull(), "add").otherwise("bump")
    return both.withColumn("action", action).where("old is null or new is null or old <> new").select("path", "name", "action", "old", "new")
