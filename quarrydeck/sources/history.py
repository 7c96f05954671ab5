"""Version-control listings as tables: status, line counts, changed names and change sets, from their raw text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def porcelain(raw: DataFrame, column: str = "raw") -> DataFrame:
    """path, old_path, index_status, status of a NUL-separated status listing (version 2).

    Ordinary and unmerged entries, renames with the path they come from in the record after
    them, untracked (??) and ignored (!!) entries; headers are left out.
    """
    records = F.split(column, "\0")
    rows = raw.select(records.alias("rs"), F.posexplode(records).alias("i", "r"))
    before = F.coalesce(F.get("rs", F.col("i") - 1), F.lit(""))
    rows = rows.where((F.col("r") != "") & ~F.startswith(before, F.lit("2 ")))
    kind = F.substring("r", 1, 2)
    skip = lambda n: F.regexp_replace("r", rf"^(?:[^ ]* ){{{n}}}", "")
    path = F.when(kind == "1 ", skip(8)).when(kind == "2 ", skip(9)).when(kind == "u ", skip(10)).otherwise(F.substring("r", 3, 1 << 30))
    code = F.when(kind == "? ", "??").when(kind == "! ", "!!").otherwise(F.substring("r", 3, 2))
    kept = rows.where(kind.isin("1 ", "2 ", "u ", "? ", "! "))
    return kept.select(path.alias("path"), F.when(kind == "2 ", F.get("rs", F.col("i") + 1)).otherwise("").alias("old_path"), F.substring(code, 1, 1).alias("index_status"), F.substring(code, 2, 1).alias("status"))


def numstat(raw: DataFrame, column: str = "raw") -> DataFrame:
    """path, added, removed: line counts, summed by path; binary files count 0, renames go to the new path."""
    rows = raw.select(F.explode(F.split(column, "\n")).alias("r")).where(F.col("r").rlike("^(\\d+|-)\t(\\d+|-)\t"))
    path = F.split_part("r", F.lit("\t"), F.lit(3))
    path = F.regexp_replace(path, r"\{[^{}]* => ([^{}]*)\}", "$1")
    path = F.regexp_replace(F.regexp_replace(path, r"^.* => ", ""), "//", "/")
    n = lambda k: F.coalesce(F.split_part("r", F.lit("\t"), F.lit(k)).try_cast("int"), F.lit(0))
    return rows.select(path.alias("path"), n(1).alias("a"), n(2).alias("r2")).groupBy("path").agg(F.sum("a").alias("added"), F.sum("r2").alias("removed"))


def name_status(raw: DataFrame, column: str = "raw") -> DataFrame:
    """path, status (added, modified or deleted) of a name-status listing; renames and copies delete the old path and add the new."""
    rows = raw.select(F.explode(F.split(column, "\n")).alias("r")).where("r <> ''")
    part = lambda k: F.split_part("r", F.lit("\t"), F.lit(k))
    code = F.substring("r", 1, 1)
    one = lambda p, s: F.struct(p.alias("path"), F.lit(s).alias("status"))
    out = F.when(code == "A", F.array(one(part(2), "added"))).when(code.isin("M", "T"), F.array(one(part(2), "modified"))).when(code == "D", F.array(one(part(2), "deleted")))
    out = out.when(code.isin("R", "C"), F.array(one(part(2), "deleted"), one(part(3), "added")))
    bad = F.raise_error(F.concat(F.lit("not a name-status line: "), F.col("r")))
    return rows.select(F.explode(F.coalesce(out, F.when(F.lit(True), F.array(F.struct(bad.cast("string").alias("path"), F.lit("").alias("status")))))).alias("x")).select("x.path", "x.status").distinct()


def _items(lines: Column) -> tuple[Column, Column]:
    """The set's name and its items, from the lines of one set."""
    rest = F.filter(lines, lambda x, i: (i > 0) & (F.trim(x) != ""))
    return F.trim(F.element_at(lines, 1)).alias("set"), F.explode(rest).alias("item")


def change_sets(raw: DataFrame, column: str = "raw", mark: str = "commit ") -> DataFrame:
    """set, item of a log listing in which a line with ``mark`` and an id begins each set of path lines."""
    lines = F.split(column, "\n")
    parts = F.filter(F.split(F.concat(F.lit("\n"), F.array_join(lines, "\n")), f"\n{mark}"), lambda p: F.trim(p) != "")
    return raw.select(F.explode(parts).alias("p")).select(*_items(F.split("p", "\n")))


def log_sets(spark: SparkSession, path: str, mark: str = "commit ", under: str | None = None) -> DataFrame:
    """set, item as change_sets() has them, of log files that any number of tasks read: Spark cuts files at their marks.

    A set is one record of the text reader, so that a file of any length is dealt out by its
    bytes, and no task holds more than one set at a time. under: only items in that folder; sets
    without any such item make no row. Sets without items, and blank lines, make no rows.
    """
    records = spark.read.option("lineSep", f"\n{mark}").text(path)
    # the first record of a file begins with the mark itself
    record = F.when(F.startswith("value", F.lit(mark)), F.substr("value", F.lit(len(mark) + 1))).otherwise(F.col("value"))
    sets = records.select(record.alias("p")).where("trim(p) <> ''").select(*_items(F.split("p", "\n")))
    return sets if under is None else sets.where(F.startswith("item", F.lit(under.rstrip("/") + "/")))


def tracked(raw: DataFrame, files: DataFrame, column: str = "raw") -> DataFrame:
    """The rows of files (path) that a NUL-separated listing of tracked paths names; a path that is listed but isn't there makes no row."""
    names = raw.select(F.explode(F.split(column, "\0")).alias("path")).where("path <> ''").distinct()
    return files.join(names, "path", "left_semi")
