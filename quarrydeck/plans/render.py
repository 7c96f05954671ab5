"""Rendering of ranked results: text, XML and JSON envelopes, and the largest prefix that fits a budget."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from quarrydeck.functions.text import xml_escape
from quarrydeck.operators.budget import running


def file_blocks(levels: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, rank, block: a file's text at its level (0 path, 1 kinds and names, 2 and more signatures)."""
    own = symbols.where("exported").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "kind", "name", "signature"))).alias("s"))
    rows = levels.where("level >= 0").join(own, "path", "left")
    short = F.transform("s", lambda x: F.concat(F.lit("  "), x["kind"], F.lit(" "), x["name"]))
    full = F.transform("s", lambda x: F.concat(F.lit("  "), x["kind"], F.lit(" "), x["name"], x["signature"], F.lit(" @"), x["line"].cast("string")))
    body = F.when(F.col("level") >= 2, full).when(F.col("level") == 1, short)
    return rows.select("path", "rank", F.concat_ws("\n", F.array("path"), F.coalesce(body, F.array().cast("array<string>"))).alias("block"))


def xml_blocks(levels: DataFrame, symbols: DataFrame) -> DataFrame:
    own = symbols.where("exported").groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "kind", "name"))).alias("s"))
    item = lambda x: F.concat(F.lit('<symbol kind="'), xml_escape(x["kind"]), F.lit('" line="'), x["line"].cast("string"), F.lit('">'), xml_escape(x["name"]), F.lit("</symbol>"))
    inner = F.coalesce(F.array_join(F.transform("s", item), ""), F.lit(""))
    return levels.where("level >= 0").join(own, "path", "left").select("path", "rank", F.concat(F.lit('<file path="'), xml_escape(F.col("path")), F.lit('">'), inner, F.lit("</file>")).alias("block"))


def json_lines(df: DataFrame, order: list) -> DataFrame:
    """One JSON object per row, in order, as ``value``."""
    return df.orderBy(*order).select(F.to_json(F.struct(*df.columns)).alias("value"))


def text(blocks: DataFrame) -> str:
    """The blocks in rank order as one text (for results that were cut to a budget)."""
    return "\n".join(r["block"] for r in blocks.orderBy("rank").toLocalIterator())


def largest_prefix(items: list, max_tokens: int, encode: Callable[[list], bytes]) -> bytes:
    """The encoding of the most leading items whose size is at most 4 bytes a token; an error if not even none fit."""
    low, high, most = 0, len(items), 4 * max_tokens
    if len(encode([])) > most:
        raise ValueError("the empty envelope exceeds the budget")
    while low < high:
        mid = (low + high + 1) // 2
        if len(encode(items[:mid])) <= most:
            low = mid
        else:
            high = mid - 1
    return encode(items[:low])


def fitting(blocks: DataFrame, max_tokens: int, envelope: int = 0) -> DataFrame:
    """The leading blocks (rank, block) whose text in rank order, with a line end each, is at most 4 bytes a token less the envelope's bytes; used: bytes so far.

    Sizes are summed up part by part (see budget.running), so that any number of blocks is cut in tasks.
    """
    sized = blocks.withColumn("bytes", (F.octet_length("block") + 1).cast("long"))
    return running(sized, ["rank"], "bytes").where(F.col("used") <= 4 * max_tokens - envelope).drop("bytes")


def bounded(raw: str, max_lines: int, max_bytes: int) -> str:
    """A text cut at whole lines and characters, with a notice of what is left out."""
    lines = raw.split("\n")
    kept = "\n".join(lines[:max_lines])
    data = kept.encode()
    if len(data) > max_bytes:
        kept = data[:max_bytes].decode("utf-8", "ignore")
    return kept if kept == raw else f"{kept}\n... {len(raw.encode()) - len(kept.encode())} bytes left out"


def with_callers(blocks: DataFrame, callers: DataFrame) -> DataFrame:
    """blocks with a line for each called symbol: its callers at hand and how many there are in all. callers: see operators.callers.callers_of."""
    seen = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("caller_path", "caller_line"))), lambda c: F.concat(c["caller_path"], F.lit(":"), c["caller_line"].cast("string"))), ", ")
    by_symbol = callers.groupBy("path", "name").agg(seen.alias("seen"), F.max("total").alias("total"))
    line = F.format_string("  %s called by %s (%d)", "name", "seen", "total")
    lines = by_symbol.groupBy("path").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"))
    return blocks.join(lines, "path", "left").select("path", "rank", F.concat_ws("\n", "block", "lines").alias("block"))


def evidence(ranked: DataFrame) -> DataFrame:
    """path, relation, class, n, caveat: what a file's place in the ranking rests on."""
    row = lambda cond, relation, kind, n, caveat: F.when(cond, F.struct(F.lit(relation).alias("relation"), F.lit(kind).alias("class"), n.cast("long").alias("n"), F.lit(caveat).alias("caveat")))
    found = F.array_compact(
        F.array(
            row(F.col("imported_by") > 0, "imported_by", "structural", F.col("imported_by"), "by the names of imports"),
            row(F.col("depends_on") > 0, "depends_on", "structural", F.col("depends_on"), "by the names of imports"),
            row(F.size("boundaries") > 0, "boundaries", "structural", F.size("boundaries"), "by import prefixes"),
            row(F.col("intra_refs") > 0, "mentions", "lexical", F.col("intra_refs"), "by equal words, which may mean other things"),
            row(F.col("untested"), "untested", "heuristic", F.lit(1), "no test file in the folder"),
        )
    )
    return ranked.select("path", F.explode(found).alias("e")).select("path", "e.*")


def source_lines(levels: DataFrame, symbols: DataFrame, files: DataFrame, most: int = 60) -> DataFrame:
    """path, rank, line, text: the first lines of the exported declarations of files shown in detail, at most ``most`` of each."""
    spans = symbols.where("exported").select("path", F.col("line").alias("first"), F.least("end_line", F.col("line") + most - 1).alias("last"))
    shown = levels.where("level >= 2").select("path", "rank").join(files.select("path", F.split("content", "\n").alias("ls")), "path").join(spans, "path")
    rows = shown.select("path", "rank", F.explode(F.sequence("first", "last")).alias("line"), "ls")
    return rows.select("path", "rank", "line", F.rtrim(F.get("ls", F.col("line") - 1)).alias("text")).distinct()
