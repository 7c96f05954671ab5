"""Relational tables viewed as the engine's inputs: files, symbols, imports, edges and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quarrydeck.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_path():
    return F.concat(F.col("source"), F.lit("/"), F.col("lang"), F.lit("/doc_"), F.col("doc_id").cast("string"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, language, package, content of documents."""
    d = spread(table(spark, sf_dir, "documents"))
    return d.select("doc_id", doc_path().alias("path"), F.col("lang").alias("language"), F.col("source").alias("package"), F.coalesce("text", F.lit("")).alias("content"))


def part_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, name, kind, line, exported, file_score of part."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat(F.lower("p_brand"), F.lit("/part_"), F.col("p_partkey").cast("string")).alias("path"), F.col("p_name").alias("name"), F.lower("p_type").alias("kind"), F.col("p_size").alias("line"), (F.col("p_size") > 5).alias("exported"), F.col("p_size").cast("long").alias("file_score"))


def order_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path (an order), imp (a part) of all lines."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("path"), F.col("l_partkey").alias("imp"))
