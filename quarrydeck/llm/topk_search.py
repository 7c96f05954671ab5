"""Exact top-k search by no-random-access aggregation over sorted lists.

Candidates are dealt to lanes, in which they come in blocks of bounded size. A block has one
sorted list per dimension, which is read in sequence from both of its ends, all lists to the
same depth. An entry that wasn't read lies between the two places that reading has reached, so
that what was read of a candidate bounds its score from below and above. A candidate whose upper
bound is under the k-th best lower bound (of the block, or of the blocks before in the lane) is
out. Reading goes deeper in steps until no query has more than a few candidates left, whose
scores are then resolved exactly; only what still isn't decided reads its lists to the end.

Bounds of all queries and candidates of a block are two matrix products per step. Each lane
keeps the k best of each query so far, which is what the next block is held against; the
answers of all lanes are merged by an exact top-k.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import ship_code, table

K = 5
#: Candidates of a block, queries that a task holds at once, and queries in one matrix product.
BLOCK, QUERY_BLOCK, CHUNK = 1024, 8192, 512
#: Rows of a lane at most, about.
LANE_ROWS = 1_000_000
#: Shares of the lists' length that are read from each end, one step after another.
DEPTHS = (1 / 4, 3 / 8, 7 / 16)
#: Survivors per query at which reading stops, as a multiple of k.
FEW = 8
SCHEMA = "query_row long, query_id long, vec_id long, score long"


class Lists:
    """The sorted lists of a block of candidates (rows of x)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.n = len(x)
        order = np.argsort(x, axis=0, kind="stable")
        self.sorted = np.take_along_axis(x, order, axis=0)
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.broadcast_to(np.arange(self.n)[:, None], x.shape), axis=0)

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What is known of each entry after reading ``depth`` entries from both ends: the middle of where it lies, and how far from it."""
        low, high = self.sorted[depth], self.sorted[self.n - 1 - depth]
        seen = (self.rank < depth) | (self.rank >= self.n - depth)
        return np.where(seen, self.x, (low + high) / 2), np.where(seen, 0.0, (high - low) / 2)


def survivors(x: np.ndarray, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int = K, depths: tuple[float, ...] = DEPTHS) -> tuple[np.ndarray, np.ndarray, int]:
    """Positions of (candidate, query) pairs among which are each query's k best of the block that reach its floor; and how many queries read some list to its end.

    own: for each query the position of its own row in the block, or -1. floor: scores that a
    candidate has to reach. All sums are exact: the caller sees to it that they are under 2 ** 52.
    """
    n, lists = len(x), Lists(x)
    steps = [lists.read(int(n * s)) for s in depths if 1 <= int(n * s) and 2 * int(n * s) < n]
    cand, asked, to_end = [], [], 0
    for at in range(0, len(q), CHUNK):
        open_ = np.arange(at, min(len(q), at + CHUNK))
        for middle, reach in (*steps, (x, None)):
            if not len(open_):
                break
            score = middle @ q[open_].T
            slack = reach @ np.abs(q[open_]).T if reach is not None else 0.0
            low, high = score - slack, score + slack
            mine = np.nonzero(own[open_] >= 0)[0]
            low[own[open_][mine], mine] = high[own[open_][mine], mine] = -np.inf
            kth = floor[open_]
            if n >= k:
                kth = np.maximum(kth, np.partition(low, n - k, axis=0)[n - k])
            keep = (high >= kth[None, :]) & (high > -np.inf)
            done = keep.sum(axis=0) <= FEW * k
            if reach is None:
                to_end += len(open_)
                done[:] = True
            c, j = np.nonzero(keep[:, done])
            cand.append(c)
            asked.append(open_[done][j])
            open_ = open_[~done]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *cand]), np.concatenate([none, *asked]), to_end


class Lane:
    """The queries of a unit, and their k best candidates among those that were added."""

    def __init__(self, k: int, block: int):
        self.k, self.block = k, block
        self.asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.q: np.ndarray | None = None
        self.best: np.ndarray | None = None  # query, score, vec_id
        self.to_end = self.searched = 0

    @staticmethod
    def joined(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        d = max(p[2].shape[1] for p in parts)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.pad(p[2], ((0, 0), (0, d - p[2].shape[1]))) for p in parts])

    def add(self, rows: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        for at in range(0, len(ids), self.block):
            self.held.append((rows[at : at + self.block], ids[at : at + self.block], x[at : at + self.block]))
            if sum(len(h[0]) for h in self.held) >= self.block:
                self.flush()

    def flush(self) -> None:
        """Hold the candidates so far against the queries."""
        if not self.held or not self.asked:
            self.held = []
            return
        if self.q is None:
            self.rows, self.ids, self.q = self.joined(self.asked)
            self.best = np.zeros((3, 0), object if self.q.dtype == object else np.int64)
        rows, ids, x = self.joined(self.held)
        self.held = []
        d = max(x.shape[1], self.q.shape[1])
        x, q = (np.pad(m, ((0, 0), (0, d - m.shape[1]))) for m in (x, self.q))
        at = {r: k for k, r in enumerate(rows.tolist())}
        own = np.array([at.get(r, -1) for r in self.rows.tolist()])
        fx, fq = x.astype(float), q.astype(float)
        if d * np.abs(fx).max(initial=0) * np.abs(fq).max(initial=0) < 2**50:
            counts = np.bincount(self.best[0].astype(np.int64), minlength=len(q))
            floor = np.full(len(q), -np.inf)
            order = np.lexsort((self.best[1], self.best[0]))  # by query, the least score first
            first = np.concatenate([[0], np.cumsum(counts)[:-1]])
            full = counts >= self.k
            floor[full] = self.best[1][order][first[full]].astype(float)
            c, j, to_end = survivors(fx, fq, own, floor, self.k)
            self.to_end, self.searched = self.to_end + to_end, self.searched + len(q)
            scores = np.einsum("ij,ij->i", fx[c], fq[j]).astype(np.int64)
        else:  # beyond exact doubles: integers of any size
            full_scores = x.astype(object) @ q.astype(object).T
            c, j = (m.ravel() for m in np.meshgrid(np.arange(len(x)), np.arange(len(q)), indexing="ij"))
            other = own[j] != c
            c, j = c[other], j[other]
            scores = full_scores[c, j]
            self.best = self.best.astype(object)
        every = np.concatenate([self.best, np.stack([j, scores, ids[c]])], axis=1)
        order = sorted(range(every.shape[1]), key=lambda i: (every[0, i], -every[1, i], every[2, i])) if every.dtype == object else np.lexsort((every[2], -every[1], every[0]))
        every = every[:, order]
        begins = np.searchsorted(every[0].astype(np.int64), np.arange(len(q)))
        place = np.arange(every.shape[1]) - begins[every[0].astype(np.int64)]
        self.best = every[:, place < self.k]

    def answers(self) -> pa.RecordBatch:
        self.flush()
        if self.best is None:
            cols: list[list[int]] = [[], [], [], []]
        else:
            j = self.best[0].astype(np.int64)
            cols = [self.rows[j].tolist(), self.ids[j].tolist(), self.best[2].tolist(), self.best[1].tolist()]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["query_row", "query_id", "vec_id", "score"])


def _matrix(lists: pa.ListArray) -> np.ndarray:
    """The rows of a list array of integers, padded with zeros."""
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((len(n), max(1, n.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def top_k(vectors: DataFrame, is_query: Column, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK, lanes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of each row for which is_query holds, ties to the smaller vec_id.

    vectors: vec_id long, v array<long> without nulls. A query's candidates are all rows but its
    own one; repeated rows are candidates each and, as queries, answer each. Vectors may differ in
    length: missing components count as 0. Scores have to fit into a long.
    """
    spark = ship_code(vectors.sparkSession)
    is_query = F.coalesce(is_query, F.lit(False))
    n, nq = vectors.agg(F.count(F.lit(1)), F.sum(is_query.cast("long"))).first()
    if not n or not nq:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    query_blocks = -(-nq // query_block)
    if lanes is None:
        parallel = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
        lanes = max(-(-n // LANE_ROWS), min(-(-parallel // query_blocks), -(-n // (4 * block))))
    # one scan deals each row as a candidate to every block of queries, and each query to every lane
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", is_query.alias("q"))
    h = F.xxhash64("row")
    to = lambda qb, lane, side: F.struct(qb.cast("int").alias("qb"), lane.cast("int").alias("lane"), F.lit(side).alias("side"))
    as_candidate = F.transform(F.sequence(F.lit(0), F.lit(query_blocks - 1)), lambda b: to(b, F.pmod(h, F.lit(lanes)), 1))
    as_query = F.when(F.col("q"), F.transform(F.sequence(F.lit(0), F.lit(lanes - 1)), lambda lane: to(F.pmod(F.xxhash64("row", F.lit(1)), F.lit(query_blocks)), lane, 0)))
    none = F.array().cast("array<struct<qb:int,lane:int,side:int>>")
    dealt = rows.select("row", "vec_id", "v", F.explode(F.concat(as_candidate, F.coalesce(as_query, none))).alias("to"))
    units = dealt.select("to.qb", "to.lane", "to.side", "row", "vec_id", "v").repartition("qb", "lane").sortWithinPartitions("qb", "lane", "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, unit = None, None
        for b in batches:
            qb, ln, side, row, ids = (b.column(i).to_numpy() for i in range(5))
            key = np.stack([qb, ln, side], axis=1)
            ends = [*(np.nonzero((key[1:] != key[:-1]).any(axis=1))[0] + 1).tolist(), len(key)]
            at = 0
            for end in ends:
                if end == at:
                    continue
                if unit != (qb[at], ln[at]):
                    if lane:
                        yield lane.answers()
                    lane, unit = Lane(k, block), (qb[at], ln[at])
                part = (row[at:end], ids[at:end], _matrix(b.column(5).slice(at, end - at)))
                if side[at] == 0:
                    lane.asked.append(part)
                else:
                    lane.add(*part)
                at = end
        if lane:
            yield lane.answers()

    found = units.mapInArrow(run, SCHEMA)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best candidates of every vector whose id is divisible by 50, on components turned into floor(256 x)."""
    raw = table(spark, sf_dir, "embeddings").where("vec_id is not null and embedding is not null")
    x = F.transform("embedding", lambda c: c.cast("double"))
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    vectors = raw.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c * 256).cast("long")).alias("v"))
    return top_k(vectors, F.col("vec_id") % 50 == 0)


ORACLE = """
with v as (
  select row_number() over () as row, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.row, q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.row <> c.row
  where q.vec_id % 50 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score from (
  select *, row_number() over (partition by row order by score desc, vec_id) as rank from s
) where rank <= 5
"""
