"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on its factor.

Entries are turned into integers, so that sums and scatter are exact whatever the order in which
Spark adds them up: tasks add their rows, centred by a whole number near the mean, and Spark
adds the tasks' cells. The driver holds a matrix of the dimension, never rows. From the scatter
it takes a Cholesky factor with complete pivoting; rotations of the factor's columns make these
orthogonal: their squared norms are then the scatter's eigenvalues, the normalised columns its
eigenvectors. Projections are worked out in tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ship_code, table

SCALE, SHIFT, TOP = 64, 1_000_000, 32
#: Entries that don't fit a long are taken as the nearest of these.
LIMIT = 2**62
#: Share of the largest pivot under which what is left of the scatter counts as rounding.
PIVOT = 1e-13
ROWS = "vec_id long, deviation decimal(38,0), component int, whitened double"


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * c) of doubles (not shifted; what is shifted cancels where it is centred)."""
    return np.clip(np.floor(vectors * SCALE), -LIMIT, LIMIT).astype(np.int64)


def _dot(x: np.ndarray) -> list[list[int]]:
    """The exact products of the columns of x (integers)."""
    top = int(np.abs(x).max(initial=0))
    if top * top * len(x) < 2**53:
        y = x.astype(np.float64)  # all partial sums are whole numbers that a double holds
        return (y.T @ y).astype(np.int64).tolist()
    return [[int(sum(a * b for a, b in zip(p, q, strict=True))) for q in x.T.tolist()] for p in x.T.tolist()]


def _add(x: np.ndarray) -> list[int]:
    if int(np.abs(x).max(initial=0)) * len(x) < 2**63:
        return x.sum(axis=0).tolist()
    return [sum(c) for c in x.T.tolist()]


def _vectors(b: pa.RecordBatch, name: str) -> np.ndarray:
    """The rows of a batch whose vectors have one length, as doubles."""
    v = b.column(b.schema.get_field_index(name))
    return v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), -1)


def usable(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v, d (its length): rows whose vector isn't null, empty, or with null or non-finite entries."""
    v = df[vector].cast("array<double>")
    fit = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return df.select(df[vec_id].cast("long").alias("vec_id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") > 0) & fit).withColumn("d", F.size("v"))


def _sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * d
        for b in batches:
            if len(b):
                x = integers(_vectors(b, "v"))
                n, total = n + len(x), [a + s for a, s in zip(total, _add(x), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, d), pa.int32()), pa.array([Decimal(s) for s in [n, *total]], pa.decimal128(38))], names=["place", "s"])

    cells = rows.select("v").mapInArrow(run, "place int, s decimal(38,0)").groupBy("place").agg(F.sum("s").alias("s"))
    got = {r["place"]: int(r["s"]) for r in cells.collect()}  # d + 1 rows
    return got[-1], [got[k] for k in range(d)]


def _scatter(rows: DataFrame, d: int, middle: list[int]) -> np.ndarray:
    """Exact sums of products of the columns, each less its middle."""
    lo, hi = np.triu_indices(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = None, False
        m = np.array(middle, np.int64)
        for b in batches:
            if len(b):
                seen = True
                x = integers(_vectors(b, "v"))
                exact = int(np.abs(x).max()) + int(np.abs(m).max()) < 2**62
                part = np.array(_dot(x - m if exact else x.astype(object) - m.astype(object)), object)
                total = part if total is None else total + part
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array([Decimal(int(s)) for s in total[lo, hi]], pa.decimal128(38))], names=["i", "j", "s"])

    cells = rows.select("v").mapInArrow(run, "i int, j int, s decimal(38,0)").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((d, d), object)
    for r in cells.collect():  # d * (d + 1) / 2 rows
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = int(r["s"])
    return out


def pivoted_cholesky(a: np.ndarray, least: float = PIVOT) -> np.ndarray:
    """L (rows in the order of a, a column for each pivot) with a = L L^T, the largest remaining diagonal first; what is left under ``least`` of the first pivot ends it."""
    a = a.copy()
    d = len(a)
    out = np.zeros((d, d))
    first = None
    for k in range(d):
        p = int(np.argmax(np.diag(a)))
        pivot = a[p, p]
        first = pivot if first is None else first
        if pivot <= 0 or pivot <= least * first:
            return out[:, :k]
        out[:, k] = a[:, p] / math.sqrt(pivot)
        a -= np.outer(out[:, k], out[:, k])
        a[p, :] = a[:, p] = 0.0
    return out


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of L L^T, by rotations of L's columns until all are orthogonal.

    A sweep is a tournament, so that the pairs of a round are rotated together.
    """
    x = factor.copy()
    d, r = x.shape
    if r == 0:
        return np.zeros(0), np.zeros((d, 0))
    seats = list(range(r + r % 2))
    eps = np.finfo(float).eps
    for _ in range(sweeps):
        worst = 0.0
        for _round in range(len(seats) - 1):
            half = len(seats) // 2
            pairs = [(min(a, b), max(a, b)) for a, b in zip(seats[:half], seats[half:][::-1], strict=True) if max(a, b) < r]
            i, j = np.array([p[0] for p in pairs], int), np.array([p[1] for p in pairs], int)
            if len(pairs):
                a, b = x[:, i], x[:, j]
                aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
                off = np.abs(ab) / np.sqrt(aa * bb)
                worst = max(worst, float(off.max()))
                turn = off > eps
                z = (bb - aa) / np.where(turn, 2 * ab, 1.0)
                t = np.where(turn, np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z)), 0.0)
                c = 1 / np.sqrt(1 + t * t)
                s = c * t
                x[:, i], x[:, j] = c * a - s * b, s * a + c * b
            seats = [seats[0], seats[-1], *seats[1:-1]]
        if worst <= 4 * eps * math.sqrt(d):
            break
    values = (x * x).sum(0)
    order = np.argsort(-values, kind="stable")
    unit = x[:, order] / np.sqrt(values[order])
    at = np.argmax(np.abs(unit), axis=0)
    return values[order], unit * np.where(unit[at, np.arange(r)] < 0, -1.0, 1.0)


def _project(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """y @ w, such that equal rows give equal results wherever they stand."""
    out = np.zeros((len(y), w.shape[1]))
    for k in range(len(w)):
        out += y[:, k : k + 1] * w[k]
    return out


def _identity_error(rows: DataFrame, n: int, k: int, centred, w: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity. Each task centres its rows by their own mean before it multiplies."""
    side = k + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, mean, inner = 0, np.zeros(k), np.zeros((k, k))
        for b in batches:
            if len(b):
                z = _project(centred(integers(_vectors(b, "v"))), w)
                here = z.mean(axis=0)
                z = z - here
                gap = here - mean
                inner += z.T @ z + np.outer(gap, gap) * (m * len(z) / (m + len(z)))
                mean, m = mean + gap * len(z) / (m + len(z)), m + len(z)
        if m:
            cells = np.zeros((side, k))
            cells[:k], cells[k] = inner + m * np.outer(mean, mean), m * mean
            yield pa.RecordBatch.from_arrays([pa.array(range(side * k), pa.int32()), pa.array(cells.ravel())], names=["place", "s"])

    cells = rows.select("v").mapInArrow(run, "place int, s double").groupBy("place").agg(F.sum("s").alias("s"))
    got = {r["place"]: r["s"] for r in cells.collect()}  # k * (k + 1) rows
    all_cells = np.array([got[p] for p in range(side * k)]).reshape(side, k)
    mean = all_cells[k] / n
    return float(np.abs(all_cells[:k] / n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(df: DataFrame, top: int = TOP, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Left out are null and empty vectors and those with null or non-finite entries, and, as one
    covariance has one dimension, vectors of another length than most have (of lengths as
    frequent, the longer one counts). Entries whose integer isn't a long are taken as the nearest
    +-2**62. Components stop at ``top`` or at the rank of the covariance: equal vectors, or a
    single one, have none and give no rows. deviation is exact, a decimal(38,0). Repeated rows and
    null ids each get their own rows.
    """
    spark = ship_code(df.sparkSession)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows = usable(df, vec_id, vector)
    most = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if most is None:
        return spark.createDataFrame([], schema)
    d = most["d"]
    rows = rows.where(F.col("d") == d).drop("d")
    n, sums = _sums(rows, d)
    middle = [round(Fraction(s, n)) for s in sums]
    off = [s - n * m for s, m in zip(sums, middle, strict=True)]  # sums of what is centred by the middle
    square = _scatter(rows, d, middle)
    exact = n * square - np.outer(np.array(off, object), np.array(off, object))  # n ** 2 times the covariance
    cov = np.array([[float(Fraction(int(c), n * n)) for c in r] for r in exact])
    values, unit = jacobi(pivoted_cholesky(cov))
    k = min(top, len(values))
    if k == 0:
        return spark.createDataFrame([], schema)
    trace = float(Fraction(int(np.trace(exact)), n * n))
    rest = np.array([float(Fraction(o, n)) for o in off])
    w = unit[:, :k] / np.sqrt(values[:k])
    m = np.array(middle, np.int64)

    def centred(x: np.ndarray) -> np.ndarray:
        if int(np.abs(x).max(initial=0)) + int(np.abs(m).max()) < 2**53:
            return (x - m).astype(np.float64) - rest
        return (x.astype(object) - m.astype(object)).astype(np.float64) - rest

    error = _identity_error(rows, n, k, centred, w)
    total = np.array(off, object)

    def deviations(x: np.ndarray) -> list[int]:
        """Sums over dimensions of (n * x - S) ** 2, from what is centred by the middle."""
        big = int(np.abs(x).max(initial=0)) + int(np.abs(m).max())
        if big < 2**62 and d * (n * big + max(map(abs, off))) ** 2 < 2**63:
            y = n * (x - m) - np.array(off, np.int64)
            return (y * y).sum(axis=1).tolist()
        y = n * (x.astype(object) - m.astype(object)) - total
        return [int(v) for v in (y * y).sum(axis=1)]

    def fits(v: int) -> Decimal | None:
        return Decimal(v) if v < 10**38 else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = integers(_vectors(b, "v"))
                ids = b.column(b.schema.get_field_index("vec_id"))
                dev = pa.array([fits(v) for v in deviations(x)], pa.decimal128(38))
                each = pa.array(np.repeat(np.arange(len(x)), k))
                yield pa.RecordBatch.from_arrays([ids.take(each), dev.take(each), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(_project(centred(x), w).ravel())], names=["vec_id", "deviation", "component", "whitened"])

    share = F.element_at(F.lit([float(v) / trace for v in values[:k]]), F.col("component"))
    return rows.select("vec_id", "v").mapInArrow(run, ROWS).select("vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 32 foremost whitened components of every usable embedding.

    Nulls, odd lengths, repeated rows, equal vectors and empty tables as whiten() has them. A
    deviation that isn't a long is null.
    """
    rows = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))
