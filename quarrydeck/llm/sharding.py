"""Sharding by balanced label propagation, in DataFrame functions alone.

Documents are linked where their texts are equal (by a star around the first of them) and where
different texts share the least or the greatest hash of their sentences, as near copies mostly do
(by stars of about STAR texts each). Linked documents start with the shard of their smallest
neighbour. In each round documents weigh the shards of their neighbours and ask for the one that
gains them most; those that have smaller neighbours alone ask in even rounds, the others in odd
ones, half of them at a time, so that neighbours don't change places for ever. As many may go
from shard to shard as others come back, directly or round several shards, and more while there
is room, those with the largest gain first. At no time do shards hold more linked documents than
their final sizes, which differ by at most one; documents without links then fill all shards to
these.

Ranks within a shard are counted in LEAD * TAIL parts of it, each numbered on its own and moved
up by the sizes of the parts before it, so that no task holds a shard. Only sizes of shards
reach the driver, and only tables of parts (at most shards ** 2 * LEAD * TAIL rows) are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, table

SHARDS = 16
#: Rounds of propagation at most; the last is an even one, in which copies follow the first of them.
ROUNDS = 7
#: Weights of a link between equal texts and of one between texts that share a sentence.
EQUAL, SHARED = 4, 1
#: Texts that are linked in one star for a shared sentence; more texts make several stars.
STAR = 64
#: Characters of a sentence that links texts, at least.
SENTENCE = 24
LEAD, TAIL = 64, 32


def ranked(df: DataFrame, part: str, lead: Column, tail: Column, out: str = "rank") -> DataFrame:
    """df with a rank from 0 without gaps within each value of ``part``, ascending by lead, then tail.

    lead and tail are integers from 0 to LEAD - 1 and TAIL - 1; within one of each the order is
    that of the column ``row``, which names each row once.
    """
    df = df.withColumn("_lead", lead.cast("int")).withColumn("_tail", tail.cast("int"))
    sizes = df.groupBy(part, "_lead", "_tail").count()
    before = Window.partitionBy(part).orderBy("_lead", "_tail").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(part, "_lead", "_tail", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    own = F.row_number().over(Window.partitionBy(part, "_lead", "_tail").orderBy("row")) - 1
    return df.withColumn("_own", own).join(F.broadcast(starts), [part, "_lead", "_tail"]).withColumn(out, (F.col("_start") + F.col("_own")).cast("long")).drop("_lead", "_tail", "_start", "_own")


def _spread(c: Column, n: int) -> Column:
    """A part from 0 to n - 1 of a hashed value."""
    return F.pmod(F.shiftrightunsigned(c, 20), n)


def _into(rank: Column, rooms: list[int]) -> Column:
    """The shard of each of the ranks 0, 1, ... when shards take as many as they have room for, in order."""
    shard, total = F.lit(0), 0
    for room in rooms[:-1]:
        total += room
        shard = shard + (rank >= total).cast("int")
    return shard


def _counts(df: DataFrame, shards: int) -> list[int]:
    got = {r["shard"]: r["count"] for r in df.groupBy("shard").count().collect()}
    return [got.get(k, 0) for k in range(shards)]


def _capped(df: DataFrame, caps: list[int]) -> DataFrame:
    """row, shard with at most caps[k] rows in shard k: the last of a full shard go where there is room."""
    counts = _counts(df, len(caps))
    if all(c <= cap for c, cap in zip(counts, caps, strict=True)):
        return df.select("row", "shard")
    cap = F.element_at(F.array(*[F.lit(c) for c in caps]), F.col("shard") + 1)
    placed = ranked(df, "shard", _spread(F.xxhash64("seed"), LEAD), _spread(F.xxhash64("row"), TAIL))
    over = placed.where(F.col("rank") >= cap).select("row", "seed", F.lit(0).alias("one"))
    moved = ranked(over, "one", _spread(F.xxhash64("seed"), LEAD), _spread(F.xxhash64("row"), TAIL)).select("row", _into(F.col("rank"), [max(0, most - c) for c, most in zip(counts, caps, strict=True)]).cast("int").alias("shard"))
    return placed.where(F.col("rank") < cap).select("row", "shard").union(moved)


def _quotas(asked: dict[int, int], rooms: list[int]) -> list[int]:
    """How many may go each way (from * shards + to) so that no shard gets more than leave it and it has room for.

    Moves go round in cycles of shards, shortest first; a step that doesn't belong to one may go
    through a shard with room. The work is on a table of shards by shards.
    """
    n = len(rooms)
    left = [[asked.get(i * n + j, 0) for j in range(n)] + [rooms[i]] for i in range(n)] + [[sum(asked.values())] * n + [0]]

    def way(a: int, b: int) -> list[int] | None:
        """The shortest way from a to b (through node n, which stands for room) on which some may go."""
        came, queue = {a: a}, [a]
        for x in queue:
            if x == b:
                path = [b]
                while path[-1] != a:
                    path.append(came[path[-1]])
                return path[::-1]
            for y in range(n + 1):
                if y not in came and left[x][y] > 0:
                    came[y] = x
                    queue.append(y)
        return None

    for i, j in sorted(((i, j) for i in range(n) for j in range(n) if left[i][j] > 0), key=lambda p: (-left[p[0]][p[1]], p)):
        while left[i][j] > 0 and (path := way(j, i)):
            steps = [(i, j), *zip(path, path[1:], strict=False)]
            count = min(left[x][y] for x, y in steps)
            for x, y in steps:
                left[x][y] -= count
    return [asked.get(i * n + j, 0) - left[i][j] for i in range(n) for j in range(n)]


def balanced_labels(rows: DataFrame, edges: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """row, shard (0 to shards - 1) for each row, counts at most one apart, few edges cut.

    rows: a column ``row`` (long, unique). edges: src and dst (long) among these, undirected, and
    their weight (1 without such a column).
    """
    n = rows.count()
    caps = [n // shards + (k < n % shards) for k in range(shards)]
    weight = (F.col("weight") if "weight" in edges.columns else F.lit(1)).cast("long").alias("weight")
    both = cut(edges.select("src", "dst", weight).union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight)).where("src <> dst"))
    start = both.groupBy(F.col("src").alias("row")).agg(F.least(F.col("src"), F.min("dst")).alias("seed"), (F.max("dst") < F.col("src")).alias("last"))
    linked = cut(start.withColumn("shard", F.pmod(F.xxhash64("seed"), shards).cast("int")))
    labels = cut(_capped(linked, caps).join(linked.select("row", "last"), "row"))
    for turn in range(rounds):
        counts = _counts(labels, shards)
        votes = both.join(labels.select(F.col("row").alias("dst"), F.col("shard").alias("to")), "dst").groupBy(F.col("src").alias("row"), "to").agg(F.sum("weight").alias("votes"))
        mine = votes.join(labels, "row")
        asks = mine.groupBy("row", "shard", "last").agg(F.max(F.struct("votes", (-F.col("to")).alias("to"))).alias("best"), F.coalesce(F.max(F.when(F.col("to") == F.col("shard"), F.col("votes"))), F.lit(0)).alias("now"))
        asks = cut(asks.select("row", "shard", "last", (-F.col("best.to")).cast("int").alias("to"), (F.col("best.votes") - F.col("now")).alias("gain")).where("gain > 0"))
        if asks.isEmpty():
            break
        asks = asks.where("last") if turn % 2 == 0 else asks.where(~F.col("last") & (F.pmod(F.xxhash64("row", F.lit(turn)), 2) == 0))
        asks = asks.withColumn("way", F.col("shard") * shards + F.col("to"))
        quota = _quotas({r["way"]: r["count"] for r in asks.groupBy("way").count().collect()}, [max(0, cap - c) for c, cap in zip(counts, caps, strict=True)])
        order = ranked(asks, "way", F.greatest(F.lit(0), F.lit(LEAD - 1) - F.col("gain")), _spread(F.xxhash64("row"), TAIL))
        moves = order.where(F.col("rank") < F.element_at(F.array(*[F.lit(q) for q in quota]), F.col("way") + 1)).select("row", "to")
        labels = cut(labels.join(moves, "row", "left").select("row", F.coalesce("to", "shard").cast("int").alias("shard"), "last"))
    labels = labels.select("row", "shard")
    counts = _counts(labels, shards)
    rooms = [cap - c for c, cap in zip(counts, caps, strict=True)]
    free = rows.select("row").join(labels.select("row"), "row", "left_anti").withColumn("one", F.lit(0))
    h = F.xxhash64("row")
    filled = ranked(free, "one", _spread(h, LEAD), _spread(F.xxhash64("row", F.lit(1)), TAIL)).select("row", _into(F.col("rank"), rooms).cast("int").alias("shard"))
    return labels.union(filled)


def cut_weight(labels: DataFrame, edges: DataFrame) -> int:
    """The weight of the edges whose ends are in different shards."""
    side = lambda c: labels.select(F.col("row").alias(c), F.col("shard").alias(f"{c}_shard"))
    return edges.join(side("src"), "src").join(side("dst"), "dst").where("src_shard <> dst_shard").agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]


def _rows(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """row, doc_id, size, text_crc32, same (the text's digest), and the least and greatest hash of its sentences."""
    t = F.coalesce(F.col(text), F.lit(""))
    sentences = F.filter(F.transform(F.split(t, r"[.!?\n]+"), lambda x: F.trim(x)), lambda x: F.length(x) >= SENTENCE)
    return df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(doc_id).cast("long").alias("doc_id"),
        (F.octet_length(t) + 1).cast("long").alias("size"),
        F.crc32(t.cast("binary")).alias("text_crc32"),
        F.unhex(F.md5(t.cast("binary"))).alias("same"),
        F.transform(sentences, lambda x: F.xxhash64(x)).alias("hashes"),
    ).select("row", "doc_id", "size", "text_crc32", "same", F.array_min("hashes").alias("low"), F.array_max("hashes").alias("high"))


def links(rows: DataFrame) -> DataFrame:
    """src, dst, weight: the links between rows as made by _rows."""
    groups = rows.groupBy("same", "size").agg(F.min("row").alias("dst"), F.count(F.lit(1)).alias("c"), F.first("low").alias("low"), F.first("high").alias("high"))
    equal = rows.select("row", "same", "size").join(groups.where("c > 1").select("same", "size", "dst"), ["same", "size"]).where("row <> dst").select(F.col("row").alias("src"), "dst", F.lit(EQUAL).alias("weight"))
    keyed = groups.select(F.col("dst").alias("row"), F.explode(F.array_distinct(F.array("low", "high"))).alias("key")).where("key is not null")
    stars = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.ceil(F.col("c") / STAR).cast("int").alias("stars"))
    dealt = keyed.join(stars, "key").select("row", "key", F.pmod(F.xxhash64("row", "key"), F.col("stars")).alias("star"))
    centres = dealt.groupBy("key", "star").agg(F.min("row").alias("dst"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    shared = dealt.join(centres, ["key", "star"]).where("row <> dst").select(F.col("row").alias("src"), "dst", F.lit(SHARED).alias("weight"))
    return equal.union(shared)


def sharded(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """One row per row of df: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text counts as empty. Law ``rows``: counts of shards differ by at most one. Repeated
    rows and ids are documents of their own. An empty df gives no rows.
    """
    rows = cut(_rows(df, doc_id, text))
    edges = links(rows)
    labels = cut(balanced_labels(rows.select("row"), edges, shards, rounds))
    h = F.xxhash64("row", F.lit(2))
    slots = ranked(labels, "shard", _spread(h, LEAD), _spread(F.xxhash64("row", F.lit(3)), TAIL), "slot")
    return rows.join(slots, "row").select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal counts, equal texts together and near copies mostly so."""
    return sharded(table(spark, sf_dir, "documents"))
