"""Incremental refresh of a snapshot from a stream of changed files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrydeck.sources import snapshots


def refresh(changes: DataFrame, folder: str, checkpoint: str, key: str = "path") -> StreamingQuery:
    """Merge each batch of ``changes`` (the snapshot's columns, a status and a long ``version``) into the snapshot below ``folder``.

    Within a batch the change with the largest version holds. Each batch writes a snapshot of its
    own and then moves the pointer ``current`` to it, so that a batch that is run again writes the
    same result. Stops when all changes at hand are taken.
    """

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        latest = rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), "version").alias("r")).select(key, "r.*")
        name = f"{folder}/v{number}-{uuid.uuid4().hex}"
        snapshots.merged(current(spark, folder), latest, key).write.parquet(name)
        spark.createDataFrame([(number, name)], "number long, name string").coalesce(1).write.mode("append").parquet(f"{folder}/pointer")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def begin(df: DataFrame, folder: str) -> None:
    """The first snapshot."""
    df.write.parquet(f"{folder}/v-start")
    df.sparkSession.createDataFrame([(-1, f"{folder}/v-start")], "number long, name string").coalesce(1).write.parquet(f"{folder}/pointer")


def current(spark, folder: str) -> DataFrame:
    row = spark.read.parquet(f"{folder}/pointer").orderBy(F.desc("number"), F.desc("name")).first()
    return spark.read.parquet(row["name"])
