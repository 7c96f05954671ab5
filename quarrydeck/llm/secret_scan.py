"""Secret scans over an incremental blob ledger, in DataFrame functions alone.

Every version of a document is addressed by its content (sha256 of its text): a blob. The
ledger holds, for each blob, which rule versions have scanned it and what these found. A scan
takes the blob and rule-version pairs that the ledger lacks, scans each such blob once however
many versions and paths hold it, adds the outcome to the ledger, and joins the ledger's findings
back to all paths.

Where a pattern's matches stand follows from the lengths of the matches and of what lies
between them, which are summed up over exploded rows (matches alone, not texts), so that time
grows in proportion to text and matches. No user code runs. Offsets are code points, ends are
exclusive; findings also hold their offsets in UTF-8 bytes, by which texts are masked.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import checkpoint_dir, free_name, let, table


@dataclass(frozen=True)
class Rule:
    """A kind of secret. pattern finds leftmost matches that don't overlap; keep: a second pattern that a match must have in full, None for all."""

    kind: str
    version: int
    pattern: str
    keep: str | None = None

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


# The base kinds in the order in which they are listed, then the kinds that this scanner adds.
_ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
BASE = (
    Rule("assign", 1, _ASSIGN + r"[A-Za-z0-9+/_.=-]+", keep=r"(?s)^" + _ASSIGN + r"[A-Za-z0-9+/_.=-]{6,}$"),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", 1, r"[0-9a-f]{24,}"),
)
ADDED = (
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("jwt", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", 1, r"(?i:bearer)\x20+[A-Za-z0-9._~+/-]{20,}"),
)
RULES = BASE + ADDED
#: A whole private key, from its header to the matching END line if that is the next such line (the header alone otherwise).
KEY = Rule("pem", 2, r"-----BEGIN ([A-Z ]{0,30})PRIVATE KEY-----(?:(?>(?s:.*?)(?=-----))-----END \1PRIVATE KEY-----)?")
#: For masking: pem:1, whose spans are the headers alone, gives way to KEY. The query reports pem:1, as its SQL does.
MASKED = tuple(KEY if r.kind == KEY.kind else r for r in RULES)

FINDINGS = "array<struct<rule:string,kind:string,start:long,end:long,first:long,last:long>>"
LEDGER = f"blob string, rules array<string>, findings {FINDINGS}"
_MATCHES = "array<struct<rule:string,at:int,ok:boolean,gap:long,width:long,gap_bytes:long,bytes:long>>"


def matches(text: Column, rule: Rule) -> Column:
    """The rule's matches in a text in order: how long the gap before each and the match are, in code points and bytes, and whether it counts."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    gaps = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    ok = (lambda m: m.rlike(rule.keep)) if rule.keep else (lambda m: F.lit(True))
    both = F.zip_with(gaps, found, lambda g, m: F.struct(F.length(g).cast("long").alias("gap"), F.length(m).cast("long").alias("width"), F.octet_length(g).cast("long").alias("gap_bytes"), F.octet_length(m).cast("long").alias("bytes"), ok(m).alias("ok")))
    named = F.transform(both, lambda x, i: F.struct(F.lit(rule.key).alias("rule"), i.alias("at"), x["ok"].alias("ok"), x["gap"].alias("gap"), x["width"].alias("width"), x["gap_bytes"].alias("gap_bytes"), x["bytes"].alias("bytes")))
    return F.when(text.rlike(rule.pattern), named).otherwise(F.array().cast(_MATCHES))


def _scanned(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """The ledger's rows of texts (blob, t, pending): one row for each, scanned by the pending rules."""
    none = F.array().cast(_MATCHES)
    found = F.concat(*[F.when(F.array_contains("pending", r.key), matches(F.col("t"), r)).otherwise(none) for r in rules])
    hits = texts.select("blob", F.col("pending").alias("rules"), F.explode_outer(found).alias("m"))
    before = Window.partitionBy("blob", "m.rule").orderBy("m.at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kind = F.lit(None).cast("string")
    for r in rules:
        kind = F.when(F.col("m.rule") == r.key, r.kind).otherwise(kind)
    end, last = F.sum(F.col("m.gap") + F.col("m.width")).over(before), F.sum(F.col("m.gap_bytes") + F.col("m.bytes")).over(before)
    placed = hits.withColumn("end", end).withColumn("last", last)
    row = F.struct(F.col("m.rule").alias("rule"), kind.alias("kind"), (F.col("end") - F.col("m.width")).alias("start"), F.col("end"), (F.col("last") - F.col("m.bytes")).alias("first"), F.col("last"))
    return placed.groupBy("blob").agg(F.first("rules").alias("rules"), F.array_sort(F.collect_list(F.when(F.col("m.ok"), row))).alias("findings"))


def empty_ledger(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], LEDGER)


def save_ledger(rows: DataFrame, path: str) -> DataFrame:
    """Add rows to the stored ledger at path; the whole ledger then."""
    rows.write.mode("append").parquet(path)
    return rows.sparkSession.read.schema(LEDGER).parquet(path)


def with_blob(versions: DataFrame, text: str = "text", out: str = "blob") -> DataFrame:
    """versions with the content address of each row's text; null counts as empty."""
    return versions.withColumn(out, F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


#: Blobs up to which a table of them is broadcast (some 60 MB); beyond, a shuffle join is used.
BROADCAST_BLOBS = 300_000


def scan(versions: DataFrame, ledger: DataFrame | None = None, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger's new rows (blob, rules, findings): each blob that some rule version hasn't seen, scanned once.

    versions: any number of versions and paths; key names a row well enough to read a blob from
    one of them. Null texts are the empty blob. A blob that one row has, and no scan has seen, is
    scanned where it lies. The others (copies, and what the ledger knows in part or whole) are
    decided by their addresses alone: one of the copies is scanned where it lies too, and only
    where several rows share key and text one of these is picked by a shuffle. The table of these
    decisions, or that of the blobs to be scanned, is broadcast if it has BROADCAST_BLOBS rows at
    most; beyond, texts are shuffled by their address.
    """
    wanted = F.array(*[F.lit(r.key) for r in rules])
    blobs = with_blob(versions.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t")), "t")
    pairs = blobs.groupBy("blob", "k").agg(F.count(F.lit(1)).alias("c"))
    one = pairs.groupBy("blob").agg(F.min(F.struct("k", "c")).alias("first"), F.sum("c").alias("n")).select("blob", "first.k", "first.c", "n")
    if ledger is not None:
        done = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        one = one.join(done, "blob", "left").withColumn("pending", F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))).drop("done")
    else:
        one = one.withColumn("pending", wanted)
    due = (F.size("pending") > 0).alias("due")
    plan = one.select(F.col("blob").alias("b"), F.col("k").alias("rk"), "c", "n", "pending", due)
    special = plan.where(~F.col("due") | (F.col("n") > 1) | (F.size("pending") < len(rules)))
    sizes = plan.agg(F.count(F.when(~F.col("due") | (F.col("n") > 1) | (F.size("pending") < len(rules)), 1)).alias("special"), F.count(F.when(F.col("due"), 1)).alias("due"), F.count(F.when(F.col("due") & (F.col("c") > 1), 1)).alias("repeated")).first()
    same = (F.col("blob") == F.col("b")) & F.col("k").eqNullSafe(F.col("rk"))
    if sizes["special"] <= BROADCAST_BLOBS:
        met = blobs.join(F.broadcast(special), F.col("blob") == F.col("b"), "left")
        chosen = met.where(F.col("b").isNull() | (F.col("due") & F.col("k").eqNullSafe(F.col("rk")))).withColumn("pending", F.coalesce("pending", wanted)).withColumn("c", F.coalesce("c", F.lit(1)))
    else:
        fresh = plan.where("due")
        chosen = blobs.join(F.broadcast(fresh) if sizes["due"] <= BROADCAST_BLOBS else fresh, same)
    chosen = chosen.select("blob", "t", "pending", "c")
    single = chosen.where("c = 1").drop("c")
    if not sizes["repeated"]:
        return _scanned(single, rules)
    again = chosen.where("c > 1").groupBy("blob", "pending").agg(F.first("t").alias("t")).select("blob", "t", "pending")
    return _scanned(single.union(again), rules)


#: Blobs with findings up to which their table is broadcast (at most some 100 MB); beyond, a shuffle join is used.
BROADCAST_FINDINGS = 300_000


def _joined_to(versions: DataFrame, by_blob: DataFrame, text: str) -> DataFrame:
    """versions with the columns of by_blob (_blob, ...) of each row's text, by a join that fits its size."""
    if by_blob.count() <= BROADCAST_FINDINGS:
        by_blob = F.broadcast(by_blob)
    return with_blob(versions, text, "_blob").join(by_blob, "_blob", "left")


def report(versions: DataFrame, ledger: DataFrame, text: str = "text") -> DataFrame:
    """versions with columns _blob and _hits: the ledger's findings in each row's text, by start, then in order of the rules."""
    rank = F.lit(len(RULES))
    for k, r in reversed(list(enumerate(RULES))):
        rank = F.when(F.col("f.kind") == r.kind, k).otherwise(rank)
    hits = ledger.where(F.size("findings") > 0).select(F.col("blob").alias("_blob"), F.explode("findings").alias("f")).select("_blob", F.struct(F.col("f.start"), rank.alias("place"), F.col("f.end"), F.col("f.kind")).alias("h"))
    by_blob = hits.groupBy("_blob").agg(F.array_sort(F.collect_set("h")).alias("_hits"))
    none = F.array().cast("array<struct<start:long,place:int,end:long,kind:string>>")
    return _joined_to(versions, by_blob, text).withColumn("_hits", F.coalesce("_hits", none))


def masked(versions: DataFrame, ledger: DataFrame, text: str = "text", mask: str = "[secret]", changed: str = "changed") -> DataFrame:
    """versions with every finding in a text, and overlapping findings together, replaced by a mask, and a column ``changed`` that says where.

    Null texts stay null. Other columns stay as they are, whatever their names (but that named by ``changed``).
    """
    hits = ledger.where(F.size("findings") > 0).select("blob", F.explode("findings").alias("f")).select("blob", "f.first", "f.last").distinct()
    by_start = Window.partitionBy("blob").orderBy("first", "last")
    reach = F.max("last").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    islands = hits.withColumn("reach", reach).withColumn("island", F.sum(F.when(F.col("first") < F.col("reach"), 0).otherwise(1)).over(by_start.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = islands.groupBy("blob", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    by_blob = merged.groupBy("blob").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    blob, spans = free_name(versions, "blob"), free_name(versions, "spans")
    by_blob = by_blob.select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    if by_blob.count() <= BROADCAST_FINDINGS:
        by_blob = F.broadcast(by_blob)
    rows = with_blob(versions, text, blob).join(by_blob, blob, "left")
    at = F.col(spans)
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(at, lambda x: x["last"]))
    ends = F.concat(F.transform(at, lambda x: x["first"]), F.array(F.octet_length(F.col(text)).cast("long")))
    kept = let(F.col(text).cast("binary"), lambda held: F.zip_with(starts, ends, lambda a, b: F.substring(held, (a + 1).cast("int"), (b - a).cast("int")).cast("string")))
    hit = F.col(spans).isNotNull() & F.col(text).isNotNull()
    columns = [F.when(hit, F.array_join(kept, mask)).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in versions.columns if c != changed]
    return rows.select(*columns, hit.alias(changed))


def _joined(hits: Column) -> Column:
    return F.array_join(F.transform(hits, lambda h: F.concat_ws(":", h["kind"], h["start"].cast("string"), h["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob.

    Two scans with a stored ledger between them: the first sees half of the documents, the second
    all of them, of which it scans what the ledger doesn't know; findings are joined to all.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{checkpoint_dir(spark).rstrip('/')}/secret-ledger-{uuid.uuid4().hex}"
    early = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False)))
    ledger = save_ledger(scan(early), path)
    ledger = save_ledger(scan(docs, ledger), path)
    base = F.filter("_hits", lambda h: h["kind"].isin(*[r.kind for r in BASE]))
    count = lambda kind: F.size(F.filter("_hits", lambda h: h["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return report(docs, ledger).select("doc_id", *[count(r.kind) for r in BASE], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("_hits")).alias("spans"), F.col("_blob").alias("blob"))
