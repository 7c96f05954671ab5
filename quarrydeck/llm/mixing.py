"""Mixing to target weights by soft membership.

A classifier trained on a labelled table gives every document a posterior for each domain. The
document rates r >= 0 for which the expected tokens of each domain, the sums over documents of
rate * tokens * posterior, come closest to the targets (relative to the domains' tokens) are
fitted by projected-gradient least squares: each round sums the expected tokens over all
documents, and every document steps by the residuals weighted with its own posteriors and is
cut off at zero. Only the sums (one number per domain) reach the driver. Rates begin at 1, and
the steps are the same function of the posteriors for all documents.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, free_name, ship_code, table

#: Labelled documents that are fitted to (about; never more than twice as many).
SAMPLE = 4000
#: Labelled documents of each domain that are fitted to at least, where there are so many (about).
LEAST = 20
BITS = 15
EPOCHS = 120
ROUNDS = 48
#: Rounds between two checkpoints of the rates.
CHUNK = 8
TOLERANCE = 1e-3

#: The targets of the query and of the pipeline, as shares of all tokens.
TARGETS = {"quality1_toxic0": 0.84, "quality0_toxic0": 0.10, "quality1_toxic1": 0.05, "quality0_toxic1": 0.01}

_SIGNS = re.compile(r"[^\w\s]")


def features(text: str | None) -> tuple[np.ndarray, int]:
    """The hashed features that a text has (distinct words, and bins of some shares of the whole text), and its words."""
    ws = text.split() if text else []
    if not ws:
        return np.zeros(0, np.int64), 0
    distinct = set(ws)
    n = len(ws)
    signs = len(_SIGNS.findall(text)) / len(text)
    upper = sum(w.isupper() for w in ws) / n
    bins = [f"\0signs{int(20 * signs)}", f"\0upper{int(10 * upper)}", f"\0distinct{int(10 * len(distinct) / n)}", f"\0words{n.bit_length()}"]
    mask = (1 << BITS) - 1
    ids = {zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) & mask for w in distinct}
    ids.update(zlib.crc32(b.encode()) & mask for b in bins)
    return np.fromiter(ids, np.int64, len(ids)), n


@dataclass
class Classifier:
    """Softmax regression on hashed features; column k of weights belongs to domains[k]."""

    domains: list[str] = field(default_factory=list)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((1 << BITS, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def posteriors(self, ids: np.ndarray) -> np.ndarray:
        z = self.bias + self.weights[ids].sum(axis=0) / max(1.0, len(ids)) ** 0.5
        e = np.exp(z - z.max())
        return e / e.sum()


def fit_classifier(rows: list[tuple[str, list[int]]], epochs: int = EPOCHS, l2: float = 1e-4) -> Classifier:
    """Fit by full-batch Adam on (domain, features)."""
    if not rows:
        return Classifier()
    domains = sorted({d for d, _ in rows})
    y = np.array([domains.index(d) for d, _ in rows])
    owner = np.repeat(np.arange(len(rows)), [len(f) for _, f in rows])
    ids = np.concatenate([np.asarray(f, np.int64) for _, f in rows]) if len(owner) else np.zeros(0, np.int64)
    scale = np.array([max(1, len(f)) ** -0.5 for _, f in rows])
    used, local = np.unique(ids, return_inverse=True)
    k = len(domains)
    w, b = np.zeros((len(used), k)), np.log(np.bincount(y, minlength=k) / len(y))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, epochs + 1):
        z = np.stack([np.bincount(owner, w[local, c], len(rows)) for c in range(k)], axis=1) * scale[:, None] + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        g = p * scale[:, None] / len(rows)
        grad = np.stack([np.bincount(local, g[owner, c], len(used)) for c in range(k)], axis=1) + l2 * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    full = np.zeros((1 << BITS, k))
    full[used] = w
    return Classifier(domains, full, b)


def learned(docs: DataFrame, labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Classifier:
    """The classifier of the labelled table (columns doc_id and domain), fitted to a bounded sample of it by hashed ids.

    Rows whose doc_id or domain is null are left out; of several domains of a document the least
    holds, and of several texts that of the least hash. All domains take part, which are few by
    nature. Whole texts are read.
    """
    ship_code(docs.sparkSession)
    labels = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    sizes = {r["domain"]: r["count"] for r in labels.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    if not total:
        return Classifier()
    # a bound for hashes of 53 bits, which doesn't round to nothing
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("domain") == name, F.lit(min(1.0, max(sample / total, LEAST / n)))).otherwise(share)
    h = F.xxhash64("doc_id")
    chosen = labels.where(F.shiftrightunsigned(h, 11) / float(1 << 53) < share).orderBy(h, "doc_id").limit(2 * sample)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = [features(t)[0] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(f, pa.list_(pa.int64())), *b.columns[2:]], names=["domain", "f", "doc_id", "h"])

    got = rows.select("domain", "text", "doc_id", F.xxhash64("text").alias("h")).mapInArrow(run, "domain string, f array<long>, doc_id long, h long")
    one = got.groupBy("doc_id", "domain").agg(F.min_by("f", "h").alias("f")).orderBy("doc_id")
    return fit_classifier([(r["domain"], r["f"]) for r in one.toLocalIterator()])


def with_posteriors(df: DataFrame, model: Classifier, text: str = "text", prefix: str = "") -> DataFrame:
    """df with columns _tokens (words) and _p0, _p1, ... (posteriors in the order of model.domains), after a prefix.

    A text without words has the prior's posteriors.
    """
    spark = ship_code(df.sparkSession)
    k = len(model.domains)
    new = [f"{prefix}_tokens", *(f"{prefix}_p{i}" for i in range(k))]
    df = df.drop(*new)
    schema = df.select("*", F.lit(0).cast("long").alias(new[0]), *[F.lit(0.0).alias(c) for c in new[1:]]).schema
    held = spark.sparkContext.broadcast(model)  # 2 ** BITS numbers for each domain

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            n, p = [], []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                ids, words = features(t)
                n.append(words)
                if k:
                    p.append(m.posteriors(ids))
            p = np.array(p).reshape(len(n), k)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64()), *[pa.array(np.ascontiguousarray(p[:, i])) for i in range(k)]], names=[*b.schema.names, *new])

    return df.mapInArrow(run, schema)


def step(rate: Column, by: list[float], prefix: str = "") -> Column:
    """A rate after one step: the posteriors weighted with ``by`` are taken off, down to zero."""
    off = F.lit(0.0)
    for i, c in enumerate(by):
        off = off + F.lit(float(c)) * F.col(f"{prefix}_p{i}")
    return F.greatest(F.lit(0.0), rate - off)


def rate(steps: list[list[float]], prefix: str = "") -> Column:
    """The rate of a row with posteriors, after all steps."""
    r = F.lit(1.0)
    for by in steps:
        r = step(r, by, prefix)
    return r


def fit_rates(rows: DataFrame, targets: list[float], rounds: int = ROUNDS) -> list[list[float]]:
    """The steps that bring the expected domain tokens of ``rows`` (_tokens, _p0, ...) to the targets.

    Least squares of the residuals in units of the square root of each domain's own curvature;
    the step size is the inverse of the largest curvature of that problem. It ends when no sum is
    off by more than TOLERANCE of all tokens, or after ``rounds``: the steps then lead to the
    closest rates so far (with targets that no rates can meet they always do).
    """
    k = len(targets)
    if not k:
        return []
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(*[F.sum(F.col("_tokens") * F.col(f"_p{i}") * F.col(f"_p{j}")) for i, j in pairs]).first()
    g = np.zeros((k, k))
    for (i, j), value in zip(pairs, got, strict=True):
        g[i, j] = g[j, i] = value or 0.0
    unit = 1 / np.sqrt(np.maximum(np.diag(g), 1e-12))
    top = np.linalg.eigvalsh(g * unit[:, None] * unit[None, :]).max()
    if top <= 0:
        return []
    steps: list[list[float]] = []
    state, r = rows.select("_tokens", *[f"_p{i}" for i in range(k)], F.lit(1.0).alias("_rate")), F.col("_rate")
    goal = np.array(targets)
    for t in range(rounds):
        sums = state.agg(*[F.sum(r * F.col("_tokens") * F.col(f"_p{i}")) for i in range(k)]).first()
        off = np.array([x or 0.0 for x in sums]) - goal
        if np.abs(off).max() <= TOLERANCE * goal.sum():
            break
        by = (off * unit * unit / top).tolist()
        steps.append(by)
        r = step(r, by)
        if t % CHUNK == CHUNK - 1:
            state, r = cut(state.withColumn("_rate", r)), F.col("_rate")
    return steps


def targets_of(rows: DataFrame, domains: list[str], weights: dict[str, float]) -> list[float]:
    """Target tokens of each domain: its share of the weights of those present, times all tokens of rows."""
    total = rows.agg(F.sum("_tokens")).first()[0] or 0
    w = [weights.get(d, 0.0) for d in domains]
    return [total * x / (sum(w) or 1.0) for x in w]


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain of the table labels: each pair of quality and toxic is a domain."""
    return labels.where("quality is not null and toxic is not null").select("doc_id", F.concat(F.lit("quality"), F.col("quality").cast("string"), F.lit("_toxic"), F.col("toxic").cast("string")).alias("domain"))


def mixed(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] = TARGETS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs repeated by their rates: floor(rate + u) times, u uniform from the hashed doc_id, so that rates hold in expectation.

    Columns stay, whatever their names. Without labels every row stays once.
    """
    model = learned(docs, labelled, doc_id, text)
    if not model.domains:
        return docs
    narrow = cut(with_posteriors(docs.select(F.col(text).alias("text")), model).drop("text"))
    steps = fit_rates(narrow, targets_of(narrow, model.domains, weights))
    prefix = ""
    while any(c.lower().startswith(f"{prefix}_") for c in docs.columns):
        prefix += "_"
    u = F.pmod(F.xxhash64(F.coalesce(F.col(doc_id), F.lit(0)), F.lit(11)), F.lit(1 << 20)) / float(1 << 20)
    copies, copy = free_name(docs, "copies"), free_name(docs, "copy")
    counted = with_posteriors(docs, model, text, prefix).withColumn(copies, F.floor(rate(steps, prefix) + u).cast("int"))
    return counted.where(F.col(copies) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[f"`{c}`" for c in docs.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of all documents for TARGETS: doc_id, n_tokens (words), domain (likeliest), posteriors (in order of the domains' names), rate."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learned(docs, quality_domains(table(spark, sf_dir, "labels")))
    rows = cut(with_posteriors(docs, model).drop("text"))
    steps = fit_rates(rows, targets_of(rows, model.domains, TARGETS))
    p = F.array(*[F.col(f"_p{i}") for i in range(len(model.domains))]) if model.domains else F.array().cast("array<double>")
    best = F.element_at(F.array(*[F.lit(d) for d in model.domains]), F.array_position(p, F.array_max(p)).cast("int")) if model.domains else F.lit(None).cast("string")
    return rows.select("doc_id", F.col("_tokens").alias("n_tokens"), best.alias("domain"), p.alias("posteriors"), rate(steps).alias("rate"))
