"""The corpus pipeline: language ID, near-dedup, secret scan, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but
the last return the columns of documents. ``run`` writes each stage's rows as Parquet in the
shared checkpoint folder and reads them again for the next.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrydeck.llm import lang_id, mixing, near_dedup, packing, secret_scan
from quarrydeck.llm.common import checkpoint_dir, cut, free_name, ship_code, table

#: Posterior under which a predicted language isn't trusted.
LEAST_SCORE = 0.5
#: Ids up to which a table of them is broadcast (at most 16 MB); beyond, a shuffle join is used.
BROADCAST_IDS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without letters, without text or with an uncertain language go.

    Where no document has a language to learn from, only those without letters or text go.
    """
    model = lang_id.learned(docs.select("doc_id", "text", "lang"))
    if not model[0]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    lang, score = free_name(docs, "lang_pred"), free_name(docs, "score")
    marked = lang_id.with_language(docs, model, lang_out=lang, score_out=score)
    return marked.where((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*[f"`{c}`" for c in docs.columns])


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity of 0.8), that of the smallest doc_id.

    Where ids repeat or are null, rows go by their place in the table instead: of each group the
    first row stays, and different texts of one id all do.
    """
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null")
    if ids.isEmpty():
        return _without(docs, "doc_id", near_dedup.near_duplicates(docs))
    row = free_name(docs, "row")
    named = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    return _without(named, row, near_dedup.near_duplicates(named, doc_id=row)).drop(row)


def _without(docs: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """docs without the rows that aren't kept; key names each row once."""
    gone = cut(found.where(~F.col("kept")).select(F.col("doc_id").alias(key)))
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    return docs.join(gone, key, "left_anti").select(*[f"`{c}`" for c in docs.columns])


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets in their texts (private keys whole) masked and n_chars counted anew where a text changed.

    With a folder in the setting ``spark.quarrydeck.secretLedger`` the ledger of earlier runs is
    read from it and added to, so that only blobs that are new to it are scanned.
    """
    kept = spark.conf.get("spark.quarrydeck.secretLedger", None)
    path = kept or f"{checkpoint_dir(spark).rstrip('/')}/secret-ledger-{uuid.uuid4().hex}"
    known = None
    if kept:
        secret_scan.save_ledger(secret_scan.empty_ledger(spark), path)
        known = spark.read.schema(secret_scan.LEDGER).parquet(path)
    ledger = secret_scan.save_ledger(secret_scan.scan(docs, known, rules=secret_scan.MASKED), path)
    changed = free_name(docs, "changed")
    wanted = F.array(*[F.lit(r.key) for r in secret_scan.MASKED])
    held = ledger.withColumn("findings", F.filter("findings", lambda f: F.array_contains(wanted, f["rule"])))
    marked = secret_scan.masked(docs, held, changed=changed)
    n = F.when(F.col(changed), F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return marked.withColumn("n_chars", n).select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, kept or left out by their rates for the target weights of the labelled domains."""
    return mixing.mixed(docs, mixing.quality_domains(table(spark, sf_dir, "labels")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packing.packed(docs)


STAGES = [
    ("language ID", language),
    ("MinHash near-dedup", near_dedup_stage),
    ("secret scans", secrets),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: Trained models and min-hashes aren't SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the pipeline makes of documents."""
    ship_code(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
