"""Source files as tables: scans with the predicates pushed to the listing, and globs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quarrydeck.functions.classify import MAX_FILE_SIZE, in_skip_dir, is_build_artifact, language


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: * and ? stay within a folder, ** crosses folders."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and "]" in glob[i + 1 :]:
            j = glob.index("]", i + 1)
            out, i = out + "[" + glob[i + 1 : j].replace("\\", "\\\\") + "]", j + 1
            continue
        out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), i + 1
    return f"^{out}$"


def stat_files(spark: SparkSession, root: str) -> DataFrame:
    """path (relative), size, mtime of every file below a root, from the listing: no content is read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return raw.select(_relative(root).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def _relative(root: str) -> Column:
    base = re.escape(root.rstrip("/").lstrip("/"))
    return F.regexp_replace("path", rf"^[a-z]+:/*{base}/", "")


def scan_files(spark: SparkSession, root: str, include: list[str] = (), exclude: list[str] = (), max_size: int = MAX_FILE_SIZE) -> DataFrame:
    """path (relative), language, size, mtime, sha256, content of the source files below a root.

    Left out, in this order: skipped folders, excluded globs, what no include glob holds (if
    there are any), unknown extensions, files over max_size (negative: no limit), build
    artefacts. The size goes to the file listing; contents are read only for what is left.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_size >= 0:
        raw = raw.where(F.col("length") <= max_size)
    base = raw.selectExpr(f"regexp_replace(path, concat('^[a-z]+:/*', regexp_replace('{root.rstrip('/').lstrip('/')}', '([.+])', '\\\\\\\\$1'), '/'), '') as path", "length as size", "modificationTime as mtime", "content")
    kept = base.where(~in_skip_dir(F.col("path")))
    for g in exclude:
        kept = kept.where(~F.col("path").rlike(glob_regex(g)))
    if include:
        kept = kept.where(F.col("path").rlike("|".join(glob_regex(g) for g in include)))
    kept = kept.withColumn("language", language(F.col("path"))).where((F.col("language") != "") & ~is_build_artifact(F.col("path")))
    return kept.select("path", "language", "size", "mtime", F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("content"))


def bounded(content: Column, most: int = 64 << 10, marker: str = "\n... cut off") -> Column:
    """The first ``most`` characters of a text that is longer, with a marker after them; for display only."""
    return F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit(marker))).otherwise(content)
