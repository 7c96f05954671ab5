"""Requests as a stream, answered batch by batch from the snapshot of the map that is current when a batch begins.

A batch's requests are reduced to its distinct questions, these are joined with the snapshot's
tables, and the answers are joined back, so that no job runs per request. Each answer names the
version it was given from. A batch that is run again replaces its own answers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrydeck.operators.packets import first_rows

REQUEST = "id string, method string, params struct<query:string,path:string,limit:int>"
#: Rows of an answer, source lines of a context, files of requests that one batch takes.
ROWS, LINES, QUEUE = 20, 60, 8
# The errors of the protocol.
PARSE, NO_METHOD, BAD_PARAMS, FAILED = -32700, -32601, -32602, -32000
METHODS = ("map/status", "symbol/find", "file/explain", "file/context")
POINTER = "number long, name string"


def publish(spark: SparkSession, tables: dict[str, DataFrame], folder: str, number: int) -> None:
    """Write a snapshot's tables (symbols, components, files), then point to them: readers see all of them or none."""
    name = f"{folder.rstrip('/')}/v{number}-{uuid.uuid4().hex}"
    for table, df in tables.items():
        df.write.parquet(f"{name}/{table}")
    spark.createDataFrame([(number, name)], POINTER).coalesce(1).write.mode("append").parquet(f"{folder.rstrip('/')}/pointer")


def latest(spark: SparkSession, folder: str) -> tuple[int, dict[str, DataFrame]]:
    """The number and the tables of the snapshot that is current."""
    row = spark.read.schema(POINTER).parquet(f"{folder.rstrip('/')}/pointer").orderBy(F.desc("number"), F.desc("name")).first()
    return row["number"], {t: spark.read.parquet(f"{row['name']}/{t}") for t in ("symbols", "components", "files")}


def questions(lines: DataFrame) -> DataFrame:
    """value, id, method, asked, code: requests as JSON lines; asked: what find and context look for, or explain's path; code: an error that needs no table."""
    q = lines.select("value", F.from_json("value", REQUEST).alias("r"))
    method = F.col("r.method")
    asked = F.when(method == "file/explain", F.col("r.params.path")).when(method.isin("symbol/find", "file/context"), F.col("r.params.query"))
    bad = F.when(F.col("r").isNull() | (F.col("r.id").isNull() & method.isNull()), PARSE).when(method.isNull() | ~method.isin(*METHODS), NO_METHOD).when((method != "map/status") & (F.coalesce(asked, F.lit("")) == ""), BAD_PARAMS)
    return q.select("value", F.col("r.id").alias("id"), method.alias("method"), asked.alias("asked"), bad.alias("code"))


def resolved(every: DataFrame, tables: dict[str, DataFrame], version: int) -> DataFrame:
    """method, asked, result: one row for each distinct question that has an answer, as JSON. every: see questions.

    tables: symbols (path, name, kind, line, end_line), components (path, component, value) and
    files (path, content). symbol/find: symbols of that name, then those that differ in case;
    file/context: the first of these with its source lines, and how many there are in all;
    file/explain: the components of the file's score; map/status: numbers of files and symbols.
    """
    good = every.where("code is null").select("method", "asked").distinct()
    symbols = tables["symbols"].select("path", "name", "kind", "line", "end_line")
    named = good.where("method in ('symbol/find', 'file/context')")
    met = named.join(symbols, F.lower("asked") == F.lower("name")).withColumn("other", (F.col("asked") != F.col("name")).cast("int"))
    order = ["other", "path", "line", "name", "kind"]
    totals = met.groupBy("method", "asked").agg(F.count(F.lit(1)).alias("total"))
    first = first_rows(met, ["method", "asked"], order, ROWS)
    match = F.struct("path", "name", "kind", "line")
    lists = first.where("method = 'symbol/find'").groupBy("method", "asked").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", match.alias("m")))), lambda x: x["m"]).alias("matches"))
    found = named.where("method = 'symbol/find'").join(lists, ["method", "asked"], "left").join(totals, ["method", "asked"], "left")
    none = F.array().cast("array<struct<path:string,name:string,kind:string,line:int>>")
    found = found.select("method", "asked", F.to_json(F.struct(F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("matches", none).alias("matches"))).alias("result"))
    best = first.where("method = 'file/context' and pos = 1").join(tables["files"].select("path", "content"), "path").join(totals, ["method", "asked"])
    length = F.coalesce(F.col("end_line"), F.col("line")) - F.col("line") + 1
    source = F.slice(F.split("content", "\n"), F.greatest(F.coalesce("line", F.lit(1)), F.lit(1)), F.greatest(F.least(length, F.lit(LINES)), F.lit(1)))
    context = best.select("method", "asked", F.to_json(F.struct("path", "name", "line", "total", source.alias("source"), (length > LINES).alias("truncated"), length.alias("lines"))).alias("result"))
    rows = F.array_sort(F.collect_list(F.struct("component", "value")))
    explained = good.where("method = 'file/explain'").join(tables["components"].select(F.col("path").alias("asked"), "component", "value"), "asked").groupBy("method", "asked").agg(F.to_json(F.struct(F.sum("value").alias("score"), rows.alias("components"))).alias("result"))
    files = tables["files"].agg(F.count(F.lit(1)).alias("files")).join(symbols.agg(F.count(F.lit(1)).alias("symbols")))  # one row each
    status = files.select(F.lit("map/status").alias("method"), F.lit(None).cast("string").alias("asked"), F.to_json(F.struct(F.lit(version).alias("version"), "files", "symbols")).alias("result"))
    return found.union(context).union(explained).union(status)


def _replies(every: DataFrame, known: DataFrame, version: int) -> DataFrame:
    """every with version, code and result; known: method, asked, result."""
    known = known.select(F.col("method").alias("_m"), F.col("asked").alias("_a"), "result")
    out = every.join(known, F.col("code").isNull() & (F.col("method") == F.col("_m")) & F.col("asked").eqNullSafe(F.col("_a")), "left")
    code = F.coalesce("code", F.when(F.col("result").isNull(), FAILED))
    return out.select("value", "id", "method", "asked", F.lit(version).cast("long").alias("version"), code.alias("code"), "result")


def answers(lines: DataFrame, tables: dict[str, DataFrame], version: int) -> DataFrame:
    """value, id, method, version, code, result: one row for each request line; result is JSON (see resolved), null where code says what is wrong."""
    every = questions(lines)
    return _replies(every, resolved(every, tables, version), version).drop("asked")


def serve(spark: SparkSession, inbox: str, snapshots: str, out: str, checkpoint: str, queue: int = QUEUE, results: str | None = None) -> StreamingQuery:
    """Answer the request files in inbox (JSON lines) that no earlier run has: at most ``queue`` files a batch, the rest wait. Ends when all at hand are answered.

    results: a folder in which each batch keeps every result once (method, asked, result); out then
    has asked in place of the result, so that it grows with the requests, not with requests times results.
    """
    lines = spark.readStream.option("maxFilesPerTrigger", queue).text(inbox)

    def batch(rows: DataFrame, number: int) -> None:
        version, tables = latest(rows.sparkSession, snapshots)
        held = rows.persist()  # the files of a batch are read once
        if results is None:
            replies = answers(held, tables, version)
        else:
            every, mine = questions(held), f"{results.rstrip('/')}/batch={number}"
            resolved(every, tables, version).write.mode("overwrite").parquet(mine)
            known = rows.sparkSession.read.parquet(mine).select("method", "asked", F.lit("").alias("result"))
            replies = _replies(every, known, version).drop("result")
        replies.write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")
        held.unpersist()

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
