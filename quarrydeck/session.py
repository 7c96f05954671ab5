"""Session factory and the small amount of session plumbing that operators share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int | str = 8, app: str = "quarrydeck", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("QUARRYDECK_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows of an Arrow batch, where the session has Spark's default: a worker's memory is a few batches of texts.
BATCH_ROWS = 1000


def ship_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started from, and bound their batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a folder below the warehouse only where none is set."""
    sc = spark.sparkContext
    set_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if set_dir is None:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        set_dir = f"{warehouse.rstrip('/')}/_checkpoints"
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(set_dir)
    return set_dir


def cut(df):
    """Cut the lineage of df with a checkpoint in the shared folder (never a local one)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffled(df):
    """df, marked so that its joins move both sides by key.

    Spark guesses a table's size from its compressed files and the columns that are read; one that
    grows with the corpus may look small by that, and its broadcast would pass whole through the driver.
    """
    return df.hint("merge")


#: Rows of a task of ``dealt`` beyond which it makes more tasks, so that the longest doesn't grow with the table.
DEALT_ROWS = 20_000


def dealt(df, key: str):
    """df dealt out by a key over four tasks a core, or more for many rows: for narrow rows of few row groups, from which far more is made than is read."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // DEALT_ROWS)), key)


def spread(df):
    """df dealt out over all cores, if its files have less than Spark's least split (``spark.sql.files.openCostInBytes``) for each.

    A file of one row group is one task, whatever is done with its rows. Only such small tables
    are moved; the scan of a larger one stays as Spark cuts it.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    least = int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.files.openCostInBytes")))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < least * cores else df
