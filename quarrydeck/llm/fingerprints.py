"""Document fingerprints from closed syncmers, in DataFrame functions alone.

A lower-cased text becomes pieces: a letter of a script without case is one; any other run of
characters but white space is cut after each of the characters ENDS, whatever its length, so
that an insertion changes no piece but its own, in a long run as in a short one. A k-mer is a run of ``k`` pieces; it is a closed syncmer if the smallest hash
among the runs of ``s`` pieces inside it is its first or last one. Whether a k-mer is selected
depends on itself alone, so equal passages select equal anchors wherever they stand. The
fingerprint holds the ``keep`` anchors of smallest hash with their first positions (every anchor
has its chance; equal texts have equal ones), as hexadecimal digits. Likeness estimates the share
of common anchors, of which those count whose displacement from one text to the other another
common anchor shares: passages match in place, chance matches don't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import free_name, let, table

#: Pieces of a k-mer (about five words of English) and of the runs inside it, and anchors of a fingerprint.
K, S, KEEP = 8, 3, 64
#: Characters that end a piece: about one in five of Latin, Greek and Cyrillic letters and of digits, one in eight of encoded data.
ENDS = "stdατот37"
#: Hexadecimal digits of an anchor's hash (of 31 bits) and of its position in a fingerprint; no string is too long for the latter.
DIGITS, PLACE = 8, 8
#: Pieces by which displacements of matching anchors may differ, about.
DRIFT = 32
_PIECE = rf"\p{{Lo}}|[^\s\p{{Lo}}{ENDS}]*+[{ENDS}]|[^\s\p{{Lo}}{ENDS}]++"
#: Parts of the id range per shuffle partition, for finding each document's successor.
PARTS = 3


def pieces(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_PIECE), F.lit(0))


def inner_hashes(words: Column, s: int = S) -> Column:
    """Hashes of the runs of s pieces, by position; of all pieces as one run where there are fewer."""
    run = lambda x, i: F.xxhash64(x, *[F.get(words, i + j) for j in range(1, s)])
    return F.when(F.size(words) < s, F.transform(words, lambda x: F.xxhash64(x))).otherwise(F.slice(F.transform(words, run), F.lit(1), F.size(words) - (s - 1)))


def _placed(h: Column, position: Column) -> Column:
    """The leading bits of a hash but for the sign, and a position, as one number that isn't negative."""
    return F.shiftleft(F.shiftrightunsigned(h, 65 - 4 * DIGITS), 4 * PLACE) + position.cast("long")


def syncmers(inner: Column, k: int = K, s: int = S) -> Column:
    """The closed syncmers of a text from its inner hashes, in order: hash and position as one number each."""
    w = k - s  # the last inner run of a k-mer starts w after its first

    def at(x, i):
        last = F.get(inner, i + w)
        least = F.least(x, *[F.get(inner, i + j) for j in range(1, w + 1)])
        return F.when((least == x) | (least == last), F.when(last.isNotNull(), _placed(F.xxhash64(x, *[F.get(inner, i + j) for j in range(s, w, s)], last), i)))

    return F.array_compact(F.transform(inner, at))


def with_fingerprint(df: DataFrame, text: str, out: str, k: int = K, s: int = S, keep: int = KEEP) -> DataFrame:
    """df with a fingerprint of column ``text``; other columns stay, whatever their names (but ``out``).

    A text in which no k-mer is selected (one with few pieces) has one anchor, all of it; a null
    text or one without pieces has none, and an empty fingerprint.
    """
    columns = [c for c in df.columns if c != out]
    words, inner, count, found = (free_name(df, c) for c in ("words", "inner", "count", "found"))
    df = df.withColumn(words, pieces(F.coalesce(F.col(text), F.lit(""))))
    df = df.withColumn(inner, inner_hashes(F.col(words), s)).withColumn(count, F.size(words)).drop(words)
    whole = F.array(_placed(F.xxhash64(F.col(inner)), F.lit(0)))
    none = F.array().cast("array<bigint>")
    df = df.withColumn(found, F.when(F.col(count) < k, none).otherwise(syncmers(F.col(inner), k, s)))
    df = df.withColumn(found, F.sort_array(F.when((F.size(found) == 0) & (F.col(count) > 0), whole).otherwise(F.col(found)))).drop(inner, count)
    hash_of = lambda x: F.shiftright(x, 4 * PLACE)
    # of an anchor that occurs again the first position stays
    first = F.filter(F.col(found), lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.coalesce(F.get(F.col(found), i - 1), F.lit(-1).cast("long")))))
    digits = F.transform(F.slice(first, 1, keep), lambda h: F.lpad(F.hex(h), DIGITS + PLACE, "0"))
    return df.withColumn(out, F.lower(F.array_join(digits, ""))).select(*[f"`{c}`" for c in columns], out)


def likeness(a: Column, b: Column, keep: int = KEEP) -> Column:
    """The estimated share (0 to 1) of common anchors of two fingerprints that match in place.

    Of the anchors in common, those count whose displacement is about that of another; a single
    one counts. Two empty fingerprints are alike, an empty one is like no other.
    """
    tokens = lambda c: F.regexp_extract_all(c, F.lit(f".{{{DIGITS + PLACE}}}"), F.lit(0))
    names = lambda xs: F.transform(xs, lambda x: F.substring(x, 1, DIGITS))

    def places(xs: Column, shared: Column) -> Column:
        mine = F.filter(xs, lambda t: F.array_contains(shared, F.substring(t, 1, DIGITS)))
        return F.transform(mine, lambda t: F.conv(F.substring(t, DIGITS + 1, PLACE), 16, 10).cast("long"))

    def held(moved: Column) -> Column:
        """How many of the sorted displacements have an equal one beside them; one alone counts."""
        beside = lambda d, i: F.coalesce(d == F.get(moved, i - 1), F.lit(False)) | F.coalesce(d == F.get(moved, i + 1), F.lit(False))
        return F.when(F.size(moved) == 1, 1).otherwise(F.size(F.filter(moved, beside)))

    def share(xs: Column, ys: Column, union: Column) -> Column:
        def of(shared: Column) -> Column:
            # both are in order of the hashes, so that the anchors in common stand side by side
            moved = F.sort_array(F.zip_with(places(xs, shared), places(ys, shared), lambda p, q: F.floor((q - p + DRIFT // 2) / DRIFT)))
            return F.when(F.size(shared) == 0, 0.0).otherwise(let(moved, held) / F.size(union))

        return let(F.array_intersect(F.array_intersect(names(xs), names(ys)), union), of)

    def both(xs: Column, ys: Column) -> Column:
        return let(F.slice(F.sort_array(F.array_union(names(xs), names(ys))), 1, keep), lambda union: share(xs, ys, union))

    found = let(tokens(a), lambda xs: let(tokens(b), lambda ys: both(xs, ys)))
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).otherwise(found).cast("double")


def successors(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with ``next_`` columns: those of the row that follows by key (then by ``columns``); the first follows the last.

    The key range is cut into parts at approximate quantiles, which are keys of rows. The rows at
    a part's first key also go to the part before, so that one shuffle suffices and no task
    holds more than a part. A null key comes first.
    """
    spark = df.sparkSession
    key_, part_, to_, at_, turn_ = (free_name(df, c) for c in ("key", "part", "to", "at", "turn"))
    parts = max(1, PARTS * int(spark.conf.get("spark.sql.shuffle.partitions")))
    low = F.lit(-(2**63))
    df = df.withColumn(key_, F.coalesce(F.col(key).cast("long"), low))
    shares = F.array(*[F.lit(i / parts) for i in range(parts)])
    got = df.agg(F.min(key_).alias("first"), F.percentile_approx(key_, shares, 20 * parts).alias("cuts")).first()
    if got["first"] is None:
        return df.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).drop(key_)
    starts = sorted({got["first"], *got["cuts"]})
    n = len(starts)
    table_ = F.expr(f"transform(split('{','.join(map(str, starts))}', ','), x -> cast(x as bigint))")
    steps = [1 << b for b in range(n.bit_length() - 1, -1, -1)]
    # binary search: the number of starts up to the key
    found = F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda acc, s: F.when((acc + s <= n) & (F.get(table_, acc + s - 1) <= F.col(key_)), acc + s).otherwise(acc)) - 1
    df = df.withColumn(part_, found)
    ghost = F.get(table_, F.col(part_)) == F.col(key_)
    before = F.pmod(F.col(part_) - 1, F.lit(n))
    own = F.struct(F.col(part_).alias("part"), F.lit(0).alias("turn"))
    places = F.when(ghost, F.array(own, F.struct(before.alias("part"), F.lit(1).alias("turn")))).otherwise(F.array(own))
    dealt = df.withColumn(to_, F.explode(places)).withColumn(at_, F.col(f"{to_}.part")).withColumn(turn_, F.col(f"{to_}.turn")).drop(to_, part_)
    order = Window.partitionBy(at_).orderBy(turn_, key_, *columns)
    out = dealt.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in columns])
    return out.where(F.col(turn_) == 0).drop(key_, at_, turn_)


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = successors(with_fingerprint(docs, "text", "fingerprint"), "doc_id", ["text", "fingerprint"])
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.col("next_text"), F.lit(1), half))
    rows = rows.withColumn("edited", edited).drop("text", "next_text").withColumn("edited_sha256", F.sha2("edited", 256))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint").drop("edited")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
