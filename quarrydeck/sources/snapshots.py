"""Snapshots of a corpus: staleness, change status and incremental merge."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

#: Share of changed files up to which a snapshot is merged rather than built anew.
MERGE_SHARE = 0.30


_POINTER = "number long, name string"


def _versions(spark: SparkSession, folder: str) -> Row | None:
    """The pointer's last row, or None where nothing was saved."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/pointer")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(_POINTER).parquet(f"{folder.rstrip('/')}/pointer").orderBy(F.desc("number"), F.desc("name")).first()


def save(df: DataFrame, folder: str) -> None:
    """Write df as a new version below folder, then point to it. What was saved before stays whole, and current until then; df may be read from it."""
    spark = df.sparkSession
    last = _versions(spark, folder)
    name = f"{folder.rstrip('/')}/v-{uuid.uuid4().hex}"
    df.write.parquet(name)
    spark.createDataFrame([(last["number"] + 1 if last else 0, name)], _POINTER).coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/pointer")


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The version that was saved last."""
    last = _versions(spark, folder)
    if last is None:
        raise FileNotFoundError(f"no snapshot was saved in {folder}")
    return spark.read.parquet(last["name"])


def status(old: DataFrame, new: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """key, status (fresh, modified, added or deleted) of every key of either snapshot."""
    a = old.select(key, F.col(value).alias("_old"), F.lit(True).alias("_was"))
    b = new.select(key, F.col(value).alias("_new"), F.lit(True).alias("_is"))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(F.col("_old").eqNullSafe(F.col("_new")), "fresh").otherwise("modified").alias("status"))


def merged(old: DataFrame, changed: DataFrame, key: str = "path") -> DataFrame:
    """old without the keys of ``changed`` (key, status), and the new rows: changed rows of status added or modified."""
    kept = old.join(changed.select(key).distinct(), key, "left_anti")
    fresh = changed.where(F.col("status").isin("added", "modified")).select(*old.columns)
    return kept.unionByName(fresh)


def worth_merging(statuses: DataFrame) -> bool:
    """Whether no more than MERGE_SHARE of the files changed."""
    row = statuses.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("status") != "fresh").cast("int")).alias("c")).first()
    return bool(row["n"]) and (row["c"] or 0) <= MERGE_SHARE * row["n"]


def digest(df: DataFrame, key: str = "path", value: str = "sha256", parts: int | None = None) -> DataFrame:
    """One row: a digest of all (key, value), the same in any order of rows. Parts are hashed first, then their hashes.

    The number of parts is a power of two that follows the number of rows, so that none grows.
    """
    if parts is None:
        parts = max(256, 1 << (df.count() // 1000).bit_length())
    line = F.concat_ws("\0", F.col(key), F.col(value))
    part = df.groupBy(F.pmod(F.xxhash64(key), parts).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(line, 256))), "\n"), 256).alias("h"))
    return part.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col("p").cast("string"), "h"))), "\n"), 256).alias("digest"))


#: Sums of hashes that make a folder's mark: each is of 60 bits of a row's sha256.
_LANES = 4


def folder_marks(df: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """folder, n, m0 to m3: sums over the (key, value) rows of each folder. Rows can be added and taken off; order and tasks don't matter."""
    line = F.sha2(F.concat_ws("\0", F.col(key), F.coalesce(F.col(value), F.lit(""))), 256)
    folder = F.when(F.instr(key, "/") > 0, F.regexp_replace(key, "/[^/]*$", "")).otherwise(".")
    rows = df.where(F.col(key).isNotNull()).select(folder.alias("folder"), line.alias("h"))
    lanes = [F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"m{k}") for k in range(_LANES)]
    return rows.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), *lanes)


def moved_marks(marks: DataFrame, gone: DataFrame, come: DataFrame) -> DataFrame:
    """The marks after the rows whose marks are ``gone`` left and those whose marks are ``come`` came: no row that stayed is read."""
    names = ["n", *[f"m{k}" for k in range(_LANES)]]
    less = gone.select("folder", *[(-F.col(c)).alias(c) for c in names])
    total = marks.unionByName(less).unionByName(come).groupBy("folder").agg(*[F.sum(c).alias(c) for c in names])
    return total.where("n > 0")


def corpus_mark(marks: DataFrame) -> DataFrame:
    """n and m0 to m3 of the whole corpus: one row, by one sum."""
    return marks.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ["n", *[f"m{k}" for k in range(_LANES)]]])


def stat_changes(old: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """key, status (same, touched, added or deleted) by size and mtime alone; both tables have key, size, mtime. touched: its content may differ."""
    a = old.select(key, F.struct("size", "mtime").alias("_was"))
    b = now.select(key, F.struct("size", "mtime").alias("_is"))
    both = a.join(b, key, "full_outer")
    return both.select(key, F.when(F.col("_was").isNull(), "added").when(F.col("_is").isNull(), "deleted").when(F.col("_was") == F.col("_is"), "same").otherwise("touched").alias("status"))


def refreshed(old: DataFrame, now: DataFrame, key: str = "path") -> DataFrame:
    """key, status (fresh, modified, added or deleted), size, mtime, sha256: what status() says, from contents of touched and added files alone.

    old: key, size, mtime, sha256; now: key, size, mtime, content. Keys whose size and mtime are as
    they were keep their sha256. Untouched contents are dropped before they are hashed; where now
    is a scan of files, look at stat_changes() first and scan only what it names.
    """
    moves = stat_changes(old, now, key)
    due = now.join(moves.where("status in ('touched', 'added')").select(key), key, "left_semi").select(key, F.sha2(F.col("content").cast("binary"), 256).alias("_new"))
    stats = now.select(key, F.col("size").alias("_size"), F.col("mtime").alias("_mtime"))
    all_ = moves.join(old.select(key, "size", "mtime", "sha256"), key, "left").join(due, key, "left").join(stats, key, "left")
    kind = F.when(F.col("status") == "same", "fresh").when(F.col("status") == "touched", F.when(F.col("sha256").eqNullSafe(F.col("_new")), "fresh").otherwise("modified")).otherwise(F.col("status"))
    there = F.col("status") != "deleted"
    return all_.select(key, kind.alias("status"), F.when(there, F.col("_size")).alias("size"), F.when(there, F.col("_mtime")).alias("mtime"), F.when(there, F.coalesce("_new", "sha256")).alias("sha256"))
