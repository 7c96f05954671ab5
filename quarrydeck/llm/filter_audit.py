"""An audit of how filters interact, from additive counts of failure masks.

Whether a text repeats another is found in three steps, so that few texts are shuffled:

1. Each task counts its texts' hashes in a counting Bloom filter: ``HASHES`` cells a text, in the
   segment of the filter that the hash names; counters stop at two. A task's part is kept as
   sorted cells with their counters. Parts are merged by adding them up, segment by segment,
   and only whether a counter reached two is kept: one bit a cell, a byte a text.
2. A text with a cell under two is surely unique and goes no further.
3. What is left (repeats, and few others by chance) is shuffled whole and grouped by its text,
   which gives each repeated text's smallest id, exactly.

The flags of all filters make a mask. Documents are counted by part, mask and labels, and every
order of filters is worked out from these counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import cut, ship_code, table

LETTERS = "ABCDE"
#: Texts of a segment on average, cells of a segment (one bitmap of Spark's), cells that a text counts in.
SEGMENT_TEXTS, CELLS, HASHES = 4096, 32768, 3
#: Segments up to which the merged filter is broadcast (4 KB each, 256 MB); beyond, texts are shuffled to their segments.
BROADCAST_SEGMENTS = 65536
#: Repeated texts up to which their table of hashes is broadcast (some 60 MB); beyond, a shuffle join is used.
BROADCAST_REPEATS = 1_000_000
#: Cells that a task holds before it gives its part so far away.
HELD = 2_000_000
_SYMBOLS = b"#$%&*|"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FEATURES = "doc_id long, part string, mask int, h1 long, h2 long"


def text_mask(raw: bytes, chars: int) -> int:
    """The bits of filters A to D (1, 2, 4, 8) that a text in UTF-8 with so many code points fails."""
    ws = raw.split()  # ASCII white space: \x20 and \x09-\x0D
    capitals = len(raw) - len(raw.translate(None, _CAPITALS))
    return (len(ws) < 100) | (100 * len(set(ws)) < 80 * len(ws)) << 1 | (100 * capitals > 10 * chars) << 2 | any(s in raw for s in _SYMBOLS) << 3


def _features(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            masks = [text_mask(raw, n) for raw, n in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks, pa.int32()), b.column(2), b.column(3)], names=["doc_id", "part", "mask", "h1", "h2"])

    return docs.select("doc_id", "part", "h1", "h2", F.col("t").cast("binary").alias("raw"), F.char_length("t").alias("chars")).mapInArrow(run, FEATURES)


def cell(k: int) -> Column:
    """The k-th cell of a text in its segment, by its second hash."""
    return F.pmod(F.shiftrightunsigned("h2", 16 * k), F.lit(CELLS)).cast("int")


def repeated_cells(hashes: DataFrame, segments: int) -> DataFrame:
    """segment, twice: a bitmap of the cells that at least two rows of hashes (h1, h2) count in. Segments without rows are missing."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """This task's part of the filter: each segment's sorted cells and their counters, which stop at two."""
        held, size = [], 0

        def part() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            n = np.minimum(n, 2).astype(np.uint8)
            seg = keys // CELLS
            first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
            last = np.r_[first[1:], len(keys)]
            cells = (keys % CELLS).astype("<u2")
            return pa.RecordBatch.from_arrays([pa.array(seg[first], pa.int64()), pa.array([cells[a:z].tobytes() for a, z in zip(first, last, strict=True)], pa.binary()), pa.array([n[a:z].tobytes() for a, z in zip(first, last, strict=True)], pa.binary())], names=["segment", "cells", "counters"])

        for b in batches:
            seg = b.column(0).to_numpy()
            for k in range(HASHES):
                held.append(seg * CELLS + b.column(1 + k).to_numpy())
            size += HASHES * len(seg)
            if size >= HELD:
                yield part()
                held, size = [], 0
        if size:
            yield part()

    def merge(t: pa.Table) -> pa.Table:
        total = np.zeros(CELLS, np.int64)
        for cells, counters in zip(t.column("cells").to_pylist(), t.column("counters").to_pylist(), strict=True):
            total[np.frombuffer(cells, "<u2")] += np.frombuffer(counters, np.uint8)
        return pa.table({"segment": t.column("segment").slice(0, 1), "twice": pa.array([np.packbits(total >= 2, bitorder="little").tobytes()], pa.binary())})

    seg = F.pmod("h1", F.lit(segments))
    parts = hashes.select(seg.alias("segment"), *[cell(k).cast("long").alias(f"c{k}") for k in range(HASHES)]).mapInArrow(count, "segment long, cells binary, counters binary")
    return parts.groupBy("segment").applyInArrow(merge, "segment long, twice binary")


def _maybe_repeated(texts: DataFrame, twice: DataFrame, segments: int) -> DataFrame:
    """The rows of texts (with h1, h2) all of whose cells were counted twice or more."""
    twice = twice.select(F.col("segment").alias("_segment"), "twice")
    if segments <= BROADCAST_SEGMENTS:
        twice = F.broadcast(twice)
    met = texts.join(twice, F.pmod("h1", F.lit(segments)) == F.col("_segment"))
    byte = lambda c: F.conv(F.hex(F.substring("twice", F.expr("1") + F.shiftright(c, 3), F.lit(1))), 16, 10).cast("int")
    bit = lambda c: F.getbit(byte(c), F.pmod(c, F.lit(8))) == 1
    all_set = bit(cell(0))
    for k in range(1, HASHES):
        all_set = all_set & bit(cell(k))
    return met.where(all_set).drop("_segment", "twice")


def repeats(docs: DataFrame, hashes: DataFrame, rows: int) -> DataFrame:
    """h1, h2, first, texts: the hashes of every text that several rows of docs have, the smallest doc_id among them, and how many texts have these hashes.

    docs: doc_id, t, h1, h2; hashes: h1, h2 of the same rows, and how many these are. Where texts
    is above one, first says nothing about a single text.
    """
    segments = max(1, -(-rows // SEGMENT_TEXTS))
    twice = cut(repeated_cells(hashes, segments))
    rest = _maybe_repeated(docs, twice, segments)
    groups = rest.groupBy("h1", "h2", "t").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    return groups.groupBy("h1", "h2").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("texts"), F.max("n").alias("n")).where("n > 1").drop("n")


def flagged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, part, mask (bits 1, 2, 4, 8, 16: fails A, B, C, D, E).

    A null text is empty, a null part the empty string. E compares whole texts over the table;
    rows without a doc_id fail no E and make none fail, nor does a repeated row of the smallest id.
    Other columns are ignored.
    """
    ship_code(docs.sparkSession)
    t = F.coalesce(docs[text], F.lit(""))
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[part].cast("string"), F.lit("")).alias("part"), t.alias("t"))
    rows = rows.select("doc_id", "part", "t", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"))
    features = cut(_features(rows))
    hashes = features.where("doc_id is not null").select("h1", "h2")
    named = rows.where("doc_id is not null").select("doc_id", "t", "h1", "h2")
    again = cut(repeats(named, hashes, hashes.count()))
    sizes = again.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("texts") > 1, 1)).alias("clashing")).first()
    small = F.broadcast(again) if sizes["n"] <= BROADCAST_REPEATS else again
    first = small.where("texts = 1").select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first")
    out = features.join(first, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    out = out.select("doc_id", "part", (F.col("mask") + F.when(F.col("first") < F.col("doc_id"), 16).otherwise(0)).alias("mask"), "h1", "h2")
    if sizes["clashing"]:
        out = _by_text(out, rows, again.where("texts > 1"))
    return out.select("doc_id", "part", "mask")


def _by_text(out: DataFrame, rows: DataFrame, clashing: DataFrame) -> DataFrame:
    """out with flag E of the rows whose hashes several texts share, held against the texts themselves."""
    hashes = clashing.select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"))
    same = (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    ours = rows.join(hashes, same, "left_semi")
    firsts = ours.groupBy(F.col("t").alias("_t")).agg(F.min("doc_id").alias("first"))
    late = ours.join(firsts, F.col("t") == F.col("_t")).select("doc_id", "part", "t", F.when(F.col("first") < F.col("doc_id"), 16).otherwise(0).cast("long").alias("h1"), "h2")
    redone = _features(late).select("doc_id", "part", (F.col("mask") + F.col("h1")).cast("int").alias("mask"), "h1", "h2")
    return out.join(hashes, same, "left_anti").unionByName(redone)


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents, and those whose doc_id has a label row with quality 1 or toxic 1."""
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")).where("good + toxic > 0")
    # rows of one id are counted before they are moved; rows without an id need no labels
    counted = masks.where("doc_id is not null").groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    met = counted.join(known, F.col("doc_id") == F.col("_id"), "left").select("part", "mask", "n", (F.col("n") * F.coalesce("good", F.lit(0))).alias("good"), (F.col("n") * F.coalesce("toxic", F.lit(0))).alias("toxic"))
    zero = F.lit(0).cast("long")
    unnamed = masks.where("doc_id is null").select("part", "mask", F.lit(1).cast("long").alias("n"), zero.alias("good"), zero.alias("toxic"))
    return met.union(unnamed).groupBy("part", "mask").agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def interactions(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What each filter does in every order, per part, from counts of masks (bit k: the k-th letter).

    part, filter_order, step, and counts: kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. One part makes a row for each order and step, whatever fails in it.
    """
    held = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))  # at most 2 ** letters
    orders = ["".join(p) for p in permutations(letters)]
    value = [(o, s + 1, 1 << letters.index(o[s]), sum(1 << letters.index(c) for c in o[:s])) for o in orders for s in range(len(letters))]
    steps = F.arrays_zip(*[F.lit([v[k] for v in value]).alias(name) for k, name in enumerate(("filter_order", "step", "own", "before"))])
    each = held.select("part", "masks", F.inline(steps))
    total = lambda of, keep: F.aggregate(F.filter("masks", keep), F.lit(0).cast("long"), lambda a, x: a + of(x))
    has = lambda x, bits: x["mask"].bitwiseAND(bits) != 0
    own, before = F.col("own"), F.col("before")
    removed = lambda x: has(x, own) & ~has(x, before)
    count = lambda x: x["n"]
    # a document that fails m filters is removed by each of them in one m-th of all orders
    share = lambda x: (x["n"] * len(orders) / F.bit_count(x["mask"])).cast("long")
    return each.select(
        "part",
        "filter_order",
        "step",
        total(count, lambda x: ~has(x, before.bitwiseOR(own))).alias("kept"),
        total(count, removed).alias("removed"),
        total(count, lambda x: has(x, own) & has(x, before)).alias("redundant"),
        total(count, lambda x: x["mask"] == own).alias("unique_fails"),
        total(lambda x: x["good"], removed).alias("good_lost"),
        total(lambda x: x["toxic"], removed).alias("toxic_lost"),
        total(share, lambda x: has(x, own)).alias("shapley"),
    )


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five filters over all documents, per language, order and step.

    Nulls, repeated rows and empty texts as flagged() and mask_counts() have them; no documents give no rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return interactions(mask_counts(flagged(docs), labels))


ORACLE = r"""
with recursive t as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, min(doc_id) over (partition by t) as first from t),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by 1),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int
  + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * coalesce(first < w.doc_id, false)::int as mask
  from w left join l on l.doc_id = w.doc_id),
f(letter, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
o(filter_order, used) as (select '', 0 union all select filter_order || letter, used + bit from o, f where used & bit = 0),
s as (select filter_order, step, bit as own, (select coalesce(sum(g.bit), 0)::int from f g where position(g.letter in filter_order) < step) as before
  from (select filter_order from o where used = 31), (select unnest(range(1, 6)) as step), f where letter = substring(filter_order, step, 1)),
c as (select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by 1, 2),
r as (select part, filter_order, step, own,
  sum(n) filter (mask & (before + own) = 0) as kept, sum(n) filter (mask & own > 0 and mask & before = 0) as removed,
  sum(n) filter (mask & own > 0 and mask & before > 0) as redundant, sum(n) filter (mask = own) as unique_fails,
  sum(good) filter (mask & own > 0 and mask & before = 0) as good_lost, sum(toxic) filter (mask & own > 0 and mask & before = 0) as toxic_lost
  from c, s group by 1, 2, 3, 4)
select part, filter_order, step::int as step, coalesce(kept, 0)::bigint as kept, coalesce(removed, 0)::bigint as removed, coalesce(redundant, 0)::bigint as redundant,
  coalesce(unique_fails, 0)::bigint as unique_fails, coalesce(good_lost, 0)::bigint as good_lost, coalesce(toxic_lost, 0)::bigint as toxic_lost,
  (sum(coalesce(removed, 0)) over (partition by part, own)) ::bigint as shapley from r
"""
