"""Tables of symbols, callers and references that other tools made."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarrydeck.sources import snapshots

ENTRY = "_type string, name string, path string, kind string, scope string, scopeKind string, signature string, language string, line int"
# Kinds that are parts of what is around them.
MEMBERS = ("member", "field", "property", "enumerator")


def tag_symbols(lines: DataFrame) -> DataFrame:
    """path, name, kind, signature, receiver, line of tags as JSON lines (value).

    Members go into the signature of what is around them in the same file, in order of lines. Lines
    that aren't JSON, aren't tags, or have no name make no row.
    """
    # as a row of its own, so that a line is parsed once and not in every filter
    t = lines.select(F.inline(F.array(F.from_json("value", ENTRY)))).where("_type = 'tag' and coalesce(name, '') <> ''")
    t = t.withColumn("scope", F.coalesce("scope", F.lit("")))
    inside = F.col("kind").isin(*MEMBERS) & (F.col("scope") != "")
    part = F.when(inside, F.struct("line", "name"))
    own = F.when(~inside, F.struct("kind", "signature", F.col("scope").alias("receiver"), "line"))
    rows = t.where(inside.isNotNull()).select("path", F.when(inside, F.col("scope")).otherwise(F.col("name")).alias("name"), part.alias("part"), own.alias("own"))
    by = rows.groupBy("path", "name").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.collect_list("own").alias("own"))
    found = by.select("path", "name", F.transform("parts", lambda x: x["name"]).alias("parts"), F.inline("own"))
    holder = F.col("path").isNotNull() & (F.size("parts") > 0) & F.col("kind").isin("class", "struct", "interface", "enum", "trait")
    signature = F.when(holder, F.concat(F.lit("{"), F.array_join("parts", ", "), F.lit("}"))).otherwise(F.coalesce("signature", F.lit("")))
    return found.select("path", "name", "kind", signature.alias("signature"), "receiver", "line")


def reference_edges(symbols: DataFrame, found: DataFrame) -> DataFrame:
    """callee_path, callee_receiver, callee_name, caller_path, caller_line: references without the place of the definition.

    symbols: path, name, receiver, line; found: name, path, line of each reference that a tool reports.
    """
    s = symbols.select(F.col("path").alias("callee_path"), F.col("receiver").alias("callee_receiver"), F.col("name").alias("callee_name"), F.col("line").alias("own"))
    r = found.select(F.col("name").alias("callee_name"), F.col("path").alias("caller_path"), F.col("line").alias("caller_line"))
    return s.join(r, "callee_name").where((F.col("callee_path") != F.col("caller_path")) | (F.col("own") != F.col("caller_line"))).select("callee_path", "callee_receiver", "callee_name", "caller_path", "caller_line").distinct()


def cached(make, files: DataFrame, folder: str) -> DataFrame:
    """The table that ``make()`` gives, stored under the digest of the files (path, sha256): made once for each state of the corpus.

    A table whose writing was cut off has no mark of success and is made anew.
    """
    spark = files.sparkSession
    path = f"{folder.rstrip('/')}/{snapshots.digest(files).first()['digest']}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
