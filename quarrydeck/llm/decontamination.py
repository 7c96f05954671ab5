"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions alone.

A record is a window of benchmark words (an item of fewer words is one window); its tokens are
its word shingles in order. A document's windows of a record's size are the other side.

1. One pass over the texts leaves the positions whose shingle some record has.
2. Shingles are ordered by rarity, i.e. by how often the documents have them. A record that is
   contained to num / den must share one of its rarest ``shingles - needed + 1`` shingles with
   the document's window: its prefix. Only prefixes are joined with the positions.
3. Such a meeting fixes where the document's window would start. It has to lie within the text
   (length), and enough positions of it must have been left by the first step (positions).
4. What remains is verified on the positions of the window, shingle by shingle, in order.

Equal windows of different items are one record; documents that hit the same groups of items
share one list of items. No user code runs, and no text leaves the task that reads it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import cut, let, table

#: What stands between words once A-Z is lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW, SHINGLE = 10, 3
#: Rows of benchmark shingles or prefixes up to which their table is broadcast (some 20 MB); beyond, a shuffle join is used.
BROADCAST_ROWS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["doc_id", "h1", "h2"]


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; null has none."""
    t = F.coalesce(text, F.lit(""))
    low = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(low, BETWEEN), "")


def shingles(ws: Column, size: int, shingle: int) -> Column:
    """(n_words, size, at, w0, w1, ...) of every run of ``size`` words, with nulls up to ``shingle`` words."""
    n = F.size(ws)  # words are got one by one: slice() would copy the whole array for each run
    at = F.when(n >= size, F.sequence(F.lit(0), F.greatest(n - size, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: _place(n, size, i, [F.get(ws, i + k) for k in range(size)], shingle))


def _place(n: Column, size: int, at: Column, ws: list[Column], shingle: int) -> Column:
    ws = ws + [F.lit(None).cast("string")] * (shingle - len(ws))
    return F.struct(n.alias("n_words"), F.lit(size).alias("size"), at.alias("at"), *[w.alias(f"w{k}") for k, w in enumerate(ws)])


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def records(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """text (a distinct window), w (its words), size (words of its shingles), gs (its shingles in order), owners (a name for its items).

    items: item_id, words.
    """
    n = F.size("words")
    starts = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n - window + 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    each = items.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("ws"))
    # the sets of items are named by their hashes; both hashes together are 128 bits
    ids = F.array_sort(F.collect_set(F.col("item_id").cast("string")))
    grouped = each.groupBy("ws").agg(ids.alias("items"))
    size = F.least(F.size("ws"), F.lit(shingle))
    gs = F.transform(F.sequence(F.lit(1), F.size("ws") - size + 1), lambda i: F.array_join(F.slice("ws", i, size), " "))
    return grouped.select(F.array_join("ws", " ").alias("text"), F.size("ws").alias("w"), size.alias("size"), gs.alias("gs"), "items", F.sha2(F.to_json("items"), 256).alias("owners"))


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, num: int = 1, den: int = 1, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_hit, n_items, items, contaminated.

    A record (``window`` item words; all words of a shorter item) occurs where at least num / den
    of its shingles of ``shingle`` words stand at their places in the document; at 1 / 1 that is
    where the document has the same words. n_hit: the document's words within occurrences;
    items: the ids of items with occurring records, as strings in order; contaminated: n_hit > 0.

    Null and empty texts have no words, neither hit nor occur. Items without an id hit words, but
    aren't listed. Rows of items that share an id are one item. Repeated rows of docs, and rows
    without a doc_id, each get their own text's answer. Other columns are ignored. Without items
    every row has zeros; without documents there are no rows.
    """
    spark = docs.sparkSession
    recs = cut(records(items.select(items[item_id].alias("item_id"), words(items[item_text]).alias("words")), window, shingle))
    ws = [f"w{k}" for k in range(shingle)]
    known = recs.select("size", F.explode("gs").alias("kg")).distinct()
    split = F.split("kg", " ")
    known = known.select("kg", F.xxhash64("size", *[F.get(split, F.lit(k)) for k in range(shingle)]).alias("kh"))
    sizes = sorted(r[0] for r in recs.select("size").distinct().collect())  # at most ``shingle`` numbers
    # a mark without words, so that every row of docs leaves at least that
    mark = spark.range(1).select(F.lit("").alias("kg"), F.xxhash64(F.lit(0)).alias("kh"))
    known = mark.union(known)

    named = docs.select(docs[doc_id].alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("t"))
    # all that needs the words is in one expression, so that a text is split once; the mark keeps every row, so that "outer" changes nothing but a filter that Spark would put before it
    places = let(words(F.col("t")), lambda v: F.concat(F.array(_place(F.size(v), 0, F.lit(0), [], shingle)), *[shingles(v, s, shingle) for s in sizes]))
    at = named.select("doc_id", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"), F.inline_outer(places))
    met = at.withColumn("g", F.concat_ws(" ", *ws)).join(_small(known, known.count()), (F.xxhash64("size", *ws) == F.col("kh")) & (F.col("g") == F.col("kg")))
    # repeated rows (same id, same text) are counted before they are moved
    left = cut(met.groupBy(*_KEY, "n_words", "size", "at", "g").agg(F.count(F.lit(1)).alias("times")))
    found = _occurrences(left.where("size > 0"), recs, num, den)
    return _report(left.where("size = 0"), found, recs)


def _occurrences(left: DataFrame, recs: DataFrame, num: int, den: int) -> DataFrame:
    """doc_id, h1, h2, start, w, owners: where records occur. left: the positions of documents whose shingle some record has."""
    often = left.groupBy("g").agg(F.sum("times").alias("often"))
    placed = recs.select("text", F.size("gs").alias("k"), F.posexplode("gs").alias("offset", "g"))
    rarity = placed.join(often, "g", "left").groupBy("text", "k").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "g", "offset"))).alias("order"))
    needed = F.greatest(F.ceil(F.col("k") * num / F.lit(den)).cast("int"), F.lit(1))
    prefix = rarity.select("text", needed.alias("needed"), F.explode(F.slice("order", 1, F.col("k") - needed + 1)).alias("p"))
    prefix = prefix.where("p.often > 0").select("text", "needed", F.col("p.g").alias("pg"), F.col("p.offset").alias("offset"))
    prefix = cut(prefix.join(recs.select("text", "w", "size", "gs", "owners"), "text"))
    # what surrounds a position, as far as a window that holds it can reach
    reach = int(recs.agg(F.max(F.size("gs"))).first()[0] or 1) - 1
    near = Window.partitionBy(*_KEY, "size").orderBy("at").rangeBetween(-reach, reach)
    around = left.withColumn("near", F.collect_list(F.struct("at", "g")).over(near))
    start = (F.col("at") - F.col("offset")).alias("start")
    cand = around.join(_small(prefix.withColumnRenamed("size", "psize"), prefix.count()), (F.col("g") == F.col("pg")) & (F.col("size") == F.col("psize")))
    cand = cand.select(*_KEY, "n_words", start, "w", "needed", "gs", "owners", "near").where("start >= 0 and start + w <= n_words")
    cand = cand.withColumn("held", F.filter("near", lambda x: (x["at"] >= F.col("start")) & (x["at"] < F.col("start") + F.size("gs")))).where(F.size("held") >= F.col("needed"))
    same = F.size(F.filter("held", lambda x: x["g"] == F.element_at("gs", x["at"] - F.col("start") + 1)))
    return cand.where(same >= F.col("needed")).select(*_KEY, "start", "w", "owners").distinct()


def _report(marks: DataFrame, found: DataFrame, recs: DataFrame) -> DataFrame:
    by_place = Window.partitionBy(*_KEY).orderBy("start", "w", "owners")
    before = F.max(F.col("start") + F.col("w")).over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    end = F.col("start") + F.col("w")
    gain = F.greatest(F.lit(0), end - F.greatest(F.col("start"), F.coalesce(before, F.col("start"))))
    hits = found.withColumn("gain", gain).groupBy(*_KEY).agg(F.sum("gain").alias("n_hit"), F.array_sort(F.collect_set("owners")).alias("groups"))
    hits = cut(hits.withColumn("lists", F.sha2(F.to_json("groups"), 256)))
    # the items of each distinct set of groups, worked out once for all documents that have it
    sets = hits.groupBy("lists").agg(F.first("groups").alias("groups")).select("lists", F.explode("groups").alias("owners"))
    owned = recs.groupBy("owners").agg(F.first("items").alias("items"))
    listed = sets.join(owned, "owners").select("lists", F.explode("items").alias("item")).groupBy("lists").agg(F.array_sort(F.collect_set("item")).alias("items"))
    rows = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _KEY]
    theirs = hits.join(listed, "lists", "left").select(*[F.col(c).alias(f"_{c}") for c in _KEY], "n_hit", "items")
    out = marks.join(theirs, rows[0] & rows[1] & rows[2], "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"), F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int"))).alias("_copy"))
    return out.drop("_copy")


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 words of every benchmark item in every document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Nulls, repeated rows and empty tables as decontaminate() has them.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontaminate(docs, items)
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
with i as (select cast(item_id as varchar) as item, {_WORDS} as w from benchmark),
iw as (select item, len(w) as k, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s, w from i where len(w) > 0),
win as (select distinct item, least(k, 10) as k, array_to_string(w[s:s + least(k, 10) - 1], ' ') as g from iw),
d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
ks as (select distinct k from win),
dw as (select r, w, k, unnest(range(1, len(w) - k + 2)) as s from d, ks where len(w) >= k),
dg as (select r, k, s, array_to_string(w[s:s + k - 1], ' ') as g from dw),
occ as (select dg.r, dg.k, dg.s, win.item from dg join win on dg.g = win.g and dg.k = win.k),
hit as (select r, count(distinct p) as n_hit from (select distinct r, unnest(range(s, s + k)) as p from occ) group by 1),
its as (select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item from occ where item is not null) group by 1)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit on hit.r = d.r left join its on its.r = d.r
"""
