"""MinHash near-duplicates with tensored banding and exact verification.

1. Each text becomes its set of word shingles; equal sets are one class (a copy costs nothing
   further) and a class is named by its smallest document.
2. A class has two small collections A and B of ``half`` tuples of ``rows`` min-hashes. A
   table key is a pair of one tuple of A and one of B, so that ``half ** 2`` tables need only
   ``2 * half * rows`` min-hashes. Tuples that no other class has are left out before pairing.
3. Leaders: in each bucket the smallest class is compared with each other member, on the full
   sets. This joins large groups of near copies at linear cost.
4. Rest: buckets that still hold several components. Within them, members whose sketches of
   ``hashes`` min-hashes agree closely enough form families, and all pairs of a family whose
   components differ are compared on the full sets, in blocks. No pair is capped or sampled.

A pair of similarity 0.85 shares no bucket with probability 2 * (1 - 0.85 ** 2) ** 8, i.e. 7e-5
at the defaults, and fails the sketch test in step 4 with probability 9e-6; no pair that
differs by more is ever linked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrydeck.operators.components import components

from .common import cut, ship_code, table

HALF, ROWS, HASHES = 8, 2, 64
#: Classes in one block of step 4, and members that one task compares with a leader at a time.
BLOCK = 512
#: Rows of ids up to which they are broadcast (16 MB); beyond, a shuffle join is used.
BROADCAST_ROWS = 1_000_000
#: Words in a worker's memo of hashes, which outlives its tasks (some 10 MB).
MEMO = 50_000

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= MEMO:
            self.clear()
        self[word] = h
        return h


_WORD = _WordHash()


def shingles(text: str | None, width: int = 3) -> np.ndarray:
    """The sorted distinct hashed shingles of ``width`` words; a shorter text's words are one shingle, no words give none.

    Words are runs of bytes other than ASCII white space, with A-Z lower-cased.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORD.__getitem__, words), np.uint64, len(words))
    n = min(width, len(h))
    out = _mix(h[: len(h) - n + 1] + _U(n))
    for k in range(1, n):
        out = _mix(out * _U(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _seeds(n: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def sketch(s: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """``hashes`` min-hashes of 32 bits of a set that isn't empty."""
    seeds, out = _seeds(hashes), np.full(hashes, 2**32 - 1, np.uint32)
    step = max(1, 65536 // hashes)
    for at in range(0, len(s), step):
        x = s[None, at : at + step] * seeds[:, None]
        x ^= x >> _U(29)
        x *= _U(0xBF58476D1CE4E5B9)
        np.minimum(out, (x >> _U(32)).astype(np.uint32).min(axis=1), out=out)
    return out


FEATURES = "doc_id long, n_shingles long, set_id binary, sketch binary"


def _features(docs: DataFrame, width: int, hashes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            n, ids, sketches = [], [], []
            for t in b.column(1).to_pylist():
                s = shingles(t, width)
                n.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sketches.append(sketch(s, hashes).astype("<u4").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(sketches, pa.binary())], names=["doc_id", "n_shingles", "set_id", "sketch"])

    return docs.mapInArrow(run, FEATURES)


def _tuples(classes: DataFrame, half: int, rows: int) -> DataFrame:
    """rep, n, place (0 to half - 1: collection A, then B), value (a hash of the tuple)."""
    width = 4 * rows
    values = F.array(*[F.xxhash64(F.lit(k), F.substring("sketch", 1 + k * width, width)) for k in range(2 * half)])
    return classes.select("rep", "n", F.posexplode(values).alias("place", "value"))


def _buckets(classes: DataFrame, half: int, rows: int) -> DataFrame:
    """key, rep, n: the table keys of the classes, without those that surely stand alone."""
    tuples = _tuples(classes, half, rows)
    shared = tuples.groupBy("place", "value").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    both = F.collect_list(F.struct("place", "value"))
    mine = tuples.join(shared, ["place", "value"]).groupBy("rep", "n").agg(both.alias("own"))
    a, b = F.filter("own", lambda x: x.place < half), F.filter("own", lambda x: x.place >= half)
    keyed = mine.select("rep", "n", F.explode(F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.xxhash64(x.place, x.value, y.place, y.value))))).alias("key"))
    return keyed.select("key", "rep", "n")


UNITS = "src long, dst long"


def _compare(sets: list[np.ndarray], sizes: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int, label: list[int]) -> list[tuple[int, int]]:
    """Links (positions) between left and right members whose labels differ, as a forest; label is updated."""
    out: list[tuple[int, int]] = []

    def find(k: int) -> int:
        while label[k] != k:
            label[k] = label[label[k]]
            k = label[k]
        return k

    if len(left) * len(right) > 4096:
        # counts by a matrix product over the shingles that both sides have
        lv, rv = np.concatenate([sets[k] for k in left]), np.concatenate([sets[k] for k in right])
        both = np.intersect1d(lv, rv)
        counts = np.zeros((len(left), len(right)), np.float64)
        if len(both):
            def columns(v: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                at = np.minimum(np.searchsorted(both, v), len(both) - 1)
                hit = both[at] == v
                return np.repeat(np.arange(len(owners)), sizes[owners])[hit], at[hit]

            (lo, lc), (ro, rc) = columns(lv, left), columns(rv, right)
            for c in range(0, len(both), 4096):
                x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
                s, t = (lc >= c) & (lc < c + 4096), (rc >= c) & (rc < c + 4096)
                x[lo[s], lc[s] - c] = 1
                y[ro[t], rc[t] - c] = 1
                counts += x @ y.T
        common = counts.astype(np.int64)  # whole numbers, held exactly
        union = sizes[left][:, None] + sizes[right][None, :] - common
        pairs = zip(*np.nonzero(den * common >= num * union), strict=True)
        found = ((int(left[i]), int(right[j])) for i, j in pairs)
        for i, j in found:
            a, b = find(i), find(j)
            if a != b:
                label[max(a, b)] = min(a, b)
                out.append((i, j))
        return out
    for i in left.tolist():
        for j in right.tolist():
            small, large = sorted((int(sizes[i]), int(sizes[j])))
            if den * small < num * large or find(i) == find(j):
                continue
            common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * common >= num * (small + large - common):
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
                out.append((i, j))
    return out


def _verified(docs: DataFrame, work: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """src, dst: links on full sets. work: rep, unit, side (0 and 1 are compared with each other, 2 with all of the unit), label (equal labels need no link)."""
    n = work.count()
    ids = F.broadcast(work) if n <= BROADCAST_ROWS else work
    rows = docs.select(F.col("doc_id").alias("rep"), "text").join(ids, "rep").select("unit", "side", "rep", "label", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        unit = None

        def links() -> pa.RecordBatch | None:
            seen: dict[tuple[int, int], tuple] = {}
            for x in held:  # repeated rows of a document
                seen.setdefault((x[0], x[1]), x)
            part = list(seen.values())
            sets = [x[3] for x in part]
            sizes = np.array([len(s) for s in sets])
            first: dict[int, int] = {}
            label = [first.setdefault(x[2], k) for k, x in enumerate(part)]
            side = np.array([x[0] for x in part])
            at = np.arange(len(part))
            if (side == 2).any():
                pairs = _compare(sets, sizes, at, at, num, den, label)
            else:
                pairs = _compare(sets, sizes, at[side == 0], at[side == 1], num, den, label)
            if not pairs:
                return None
            return pa.RecordBatch.from_arrays([pa.array([part[i][1] for i, _ in pairs], pa.int64()), pa.array([part[j][1] for _, j in pairs], pa.int64())], names=["src", "dst"])

        for b in batches:
            for u, s, r, lab, t in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if u != unit:
                    if len(held) > 1 and (found := links()):
                        yield found
                    held, unit = [], u
                held.append((s, r, lab, shingles(t, width)))
        if len(held) > 1 and (found := links()):
            yield found

    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(run, UNITS)


def _leaders(members: DataFrame, num: int, den: int) -> DataFrame:
    """Work for step 3: the smallest class of each bucket against its other members."""
    head = members.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("head"), F.count(F.lit(1)).alias("c")).where("c > 1").select("key", F.col("head.rep").alias("lead"), F.col("head.n").alias("lead_n"))
    close = F.lit(den) * F.least("n", "lead_n") >= F.lit(num) * F.greatest("n", "lead_n")
    pairs = cut(members.join(head, "key").where((F.col("rep") != F.col("lead")) & close).select("lead", "rep").distinct())
    sizes = pairs.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    large = sizes.where("parts > 1")  # one row at most for BLOCK pairs; the pairs of such leaders aren't shuffled by them
    if large.count() <= BROADCAST_ROWS:
        large = F.broadcast(large)
    part = F.pmod(F.xxhash64("rep"), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = pairs.join(large, "lead", "left").select(F.col("rep"), F.xxhash64("lead", part).alias("unit"), F.lit(1).alias("side"), F.col("rep").alias("label"))
    heads = sizes.select(F.col("lead").alias("rep"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "lead")
    return dealt.union(heads.select("rep", F.xxhash64("lead", "part").alias("unit"), F.lit(0).alias("side"), F.col("rep").alias("label")))


def _alike(mixed: DataFrame, agree: int, num: int, den: int) -> DataFrame:
    """src, dst: a forest over the members of each bucket whose sketches agree and whose sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, bytes]] = []
        unit = None

        def links() -> pa.RecordBatch:
            reps = np.array([x[0] for x in held])
            comps = np.array([x[1] for x in held])
            n = np.array([x[2] for x in held])
            sk = np.stack([np.frombuffer(x[3], "<u4") for x in held])
            first: dict[int, int] = {}
            label = [first.setdefault(c, k) for k, c in enumerate(comps.tolist())]

            def find(k: int) -> int:
                while label[k] != k:
                    label[k] = label[label[k]]
                    k = label[k]
                return k

            out = []
            major = max(first, key=lambda c: int((comps == c).sum()))
            for i in np.nonzero(comps != major)[0].tolist():
                ok = (comps != comps[i]) & (den * np.minimum(n, n[i]) >= num * np.maximum(n, n[i]))
                at = np.nonzero(ok)[0]
                if len(at):
                    for j in at[(sk[at] == sk[i]).sum(axis=1) >= agree].tolist():
                        a, b = find(i), find(j)
                        if a != b:
                            label[max(a, b)] = min(a, b)
                            out.append((int(reps[i]), int(reps[j])))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["src", "dst"])

        for b in batches:
            for u, *x in zip(*(b.column(k).to_pylist() for k in range(5)), strict=True):
                if u != unit:
                    if len(held) > 1:
                        yield links()
                    held, unit = [], u
                held.append(tuple(x))
        if len(held) > 1:
            yield links()

    return mixed.select("unit", "rep", "comp", "n", "sketch").repartition("unit").sortWithinPartitions("unit").mapInArrow(run, UNITS)


def _blocked(members: DataFrame, group: str, rest: list[str], block: int) -> DataFrame:
    """The rows of each group dealt to units such that any two rows whose comp differs meet in one.

    members: group, comp, rep and rest. The group's largest component is dealt to blocks of its
    own, which are never compared with one another. Adds unit and side.
    """
    parts = members.groupBy(group, "comp").agg(F.count(F.lit(1)).alias("c"))
    top = parts.groupBy(group).agg(F.max(F.struct("c", "comp")).alias("top"), F.sum("c").alias("all"))
    minor = F.greatest(F.lit(1), F.ceil((F.col("all") - F.col("top.c")) / block)).cast("int")
    plan = top.select(group, F.col("top.comp").alias("top_comp"), (F.col("all") <= block).alias("one"), minor.alias("minor"), F.ceil(F.col("top.c") / block).cast("int").alias("major"))
    x = members.join(plan, group).withColumn("is_top", F.col("comp") == F.col("top_comp"))
    h = F.xxhash64("rep", F.lit(7))
    own = F.when(F.col("is_top"), F.pmod(h, "major")).otherwise(F.pmod(h, "minor")).cast("int")
    x = x.withColumn("own", own)
    pair = lambda a, b, s: F.struct(F.xxhash64(F.col(group), a, b).alias("unit"), s.alias("side"))
    one = F.array(pair(F.lit(-1), F.lit(-1), F.lit(2)))
    minors, majors = F.sequence(F.lit(0), F.col("minor") - 1), F.sequence(F.lit(0), F.col("major") - 1)
    of_top = F.transform(minors, lambda b: pair(b, F.col("own") + F.lit(1 << 24), F.lit(1)))
    with_top = F.transform(majors, lambda b: pair(F.col("own"), b + F.lit(1 << 24), F.lit(0)))
    among = F.transform(minors, lambda b: pair(F.least(F.col("own"), b), F.greatest(F.col("own"), b), F.when(b == F.col("own"), 2).otherwise((b < F.col("own")).cast("int"))))
    to = F.when(F.col("one"), one).when(F.col("is_top"), of_top).otherwise(F.concat(with_top, among))
    return x.select("rep", "comp", *rest, F.explode(to).alias("to")).select("to.unit", "to.side", "rep", "comp", *rest)


def _rest(members: DataFrame, classes: DataFrame, comps: DataFrame, agree: int, num: int, den: int) -> DataFrame | None:
    """Work for step 4, or None if no bucket holds two components."""
    placed = members.join(comps, F.col("rep") == F.col("node"), "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    inside = placed.join(mixed, "key")
    dealt = cut(_blocked(inside, "key", ["n"], 2 * BLOCK))
    near = dealt.join(classes.select("rep", "sketch"), "rep")
    alike = cut(_alike(near, agree, num, den).distinct())
    if alike.isEmpty():
        return None
    ends = alike.select(F.col("src").alias("rep")).union(alike.select(F.col("dst").alias("rep"))).distinct()
    mine = ends.join(comps, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("comp"))
    # families: components of step 3 that sketches join; all their members take part
    by_comp = alike.join(mine.select(F.col("rep").alias("src"), F.col("comp").alias("a")), "src").join(mine.select(F.col("rep").alias("dst"), F.col("comp").alias("b")), "dst").select("a", "b").distinct()
    family = components(by_comp, "a", "b").select(F.col("node").alias("comp"), F.col("component").alias("family"))
    everyone = comps.select(F.col("node").alias("rep"), F.col("component").alias("comp")).union(mine).distinct()
    people = cut(everyone.join(family, "comp").select("family", "comp", "rep"))
    return _blocked(people, "family", [], BLOCK).select("rep", "unit", "side", F.col("comp").alias("label"))


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, num: int = 80, den: int = 100, half: int = HALF, rows: int = ROWS, hashes: int = HASHES, agree: int | None = None) -> DataFrame:
    """One row per row of df: doc_id, n_shingles, component_id, kept.

    Two documents are linked if den * |intersection| >= num * |union| of their shingle sets.
    component_id is the smallest doc_id that links reach, kept says whether it is the row's own.
    Texts that are null or have no words have no shingles, link with nothing and are kept.
    Repeated rows get equal answers. Rows without a doc_id can't be named: they link with nothing,
    their component_id is null and they are kept. Other columns of df are ignored.
    """
    spark = ship_code(df.sparkSession)
    if agree is None:
        t = num / den
        agree = int(hashes * t - 4.5 * (hashes * t * (1 - t)) ** 0.5)
    docs = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    features = cut(_features(docs, width, hashes))
    named = features.where("set_id is not null and doc_id is not null")
    classes = cut(named.groupBy("set_id", "sketch", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("rep")))
    members = cut(_buckets(classes, half, rows))
    docs = docs.where("doc_id is not null")
    links = cut(_verified(docs, _leaders(members, num, den), width, num, den))
    comps = cut(components(links))
    work = _rest(members, classes, comps, agree, num, den)
    if work is not None:
        more = cut(_verified(docs, cut(work), width, num, den))
        if not more.isEmpty():
            comps = cut(components(links.union(more)))
    by_set = classes.join(comps, F.col("rep") == F.col("node"), "left").select("set_id", F.coalesce("component", "rep").alias("linked"))
    out = features.join(by_set, "set_id", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("linked", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on 3-word shingles at 85 hundredths."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=3, num=85)
