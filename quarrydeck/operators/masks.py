"""Lines without comments and without what stands in strings over several lines, by column expressions alone.

What a line does to the state it starts in (code, or inside one of a language's blocks) is a
function from states to states, known from the line by itself. Functions are composed within
blocks of lines, these blocks' functions within blocks of blocks, and so on; what comes out on
top is handed back down, so that each line learns its state however long its file is, and no
task holds more than one block.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from quarrydeck.session import cut

#: Lines in one block.
BLOCK = 256
#: Lines inside of blocks up to which their table is broadcast (some 60 MB); beyond, a shuffle join is used.
BROADCAST_LINES = 1_000_000


@dataclass(frozen=True)
class Block:
    """What may go over several lines: its ends, and a pattern of what is between them that holds no end. string: it counts as text if it ends on its line."""

    opens: str
    closes: str
    body: str
    string: bool = False


@dataclass(frozen=True)
class Style:
    line_comment: str
    blocks: tuple[Block, ...]
    strings: tuple[str, ...]


# How languages write comments and strings. Bodies are possessive, so that long lines need no deep stack.
_QUOTED = r'"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\z)'
_SINGLE = r"'[^'\\]*+(?:\\.[^'\\]*+)*+(?:'|\z)"
_SLASHED = Block("/*", "*/", r"[^*]*+(?:\*(?!/)[^*]*+)*+")
_TRIPLE = tuple(Block(q * 3, q * 3, rf"[^{q}\\]*+(?:(?:\\.|{q}(?!{q}{q}))[^{q}\\]*+)*+", True) for q in "\"'")
STYLES = {
    "go": Style("//", (_SLASHED, Block("`", "`", "[^`]*+", True)), (_QUOTED, _SINGLE)),
    "typescript": Style("//", (_SLASHED, Block("`", "`", r"[^`\\]*+(?:\\.[^`\\]*+)*+", True)), (_QUOTED, _SINGLE)),
    "java": Style("//", (_SLASHED,), (_QUOTED, _SINGLE)),
    "rust": Style("//", (_SLASHED,), (_QUOTED, r"'(?:\\.|[^'\\])'")),
    "python": Style("#", _TRIPLE, (_QUOTED, _SINGLE)),
    "ruby": Style("#", (), (_QUOTED, _SINGLE)),
}
STYLES |= {"javascript": STYLES["typescript"], "c": STYLES["java"], "cpp": STYLES["java"]}


def _tokens(style: Style) -> str:
    """A comment, or a string, or a block as far as the line goes."""
    blocks = [re.escape(b.opens) + b.body + rf"(?:{re.escape(b.closes)}|\z)" for b in style.blocks]
    return "(?s)" + "|".join([re.escape(style.line_comment) + ".*", *blocks, *style.strings])


def _cleaned(text: Column, style: Style, strings: bool) -> Column:
    """Code without comments and without a block that goes on; with ``strings``, what is text on this line stays."""
    whole = [re.escape(b.opens) + b.body + re.escape(b.closes) for b in style.blocks if b.string]
    gone = [re.escape(style.line_comment) + ".*", *[re.escape(b.opens) + b.body + (r"\z" if b.string else rf"(?:{re.escape(b.closes)}|\z)") for b in style.blocks]]
    pattern = f"(?s)({'|'.join(whole) or '(?!)'})|{'|'.join(gone)}|({'|'.join(style.strings)})"
    return F.regexp_replace(text, F.lit(pattern), F.lit("$1$2" if strings else ""))


def _after(text: Column, b: Block) -> Column:
    """What follows the end of block b on a line that starts within it, or null if it doesn't end there."""
    ends = rf"(?s)^{b.body}{re.escape(b.closes)}"
    return F.when(text.rlike(ends), F.regexp_replace(text, F.lit(ends), F.lit("")))


def _end(code: Column, style: Style) -> Column:
    """The state after code: 0, or the block that its last token leaves open (from 1)."""
    last = F.element_at(F.concat(F.array(F.lit("")), F.regexp_extract_all(code, F.lit(_tokens(style)), F.lit(0))), -1)
    state = F.lit(0)
    for i, b in reversed(list(enumerate(style.blocks, 1))):
        state = F.when(last.rlike(rf"(?s)^{re.escape(b.opens)}{b.body}\z"), i).otherwise(state)
    return state


def line_functions(rows: DataFrame, style: Style, text: str = "text") -> DataFrame:
    """rows with f: the state that each state ends in, in order of states."""
    identity = F.array(*[F.lit(i) for i in range(len(style.blocks) + 1)])
    t = F.col(text)
    ends = [_end(t, style), *[F.when(_after(t, b).isNull(), i).otherwise(_end(_after(t, b), style)) for i, b in enumerate(style.blocks, 1)]]
    marks = "|".join(re.escape(m) for b in style.blocks for m in (b.opens, b.closes)) or "(?!)"
    return rows.withColumn("f", F.when(t.rlike(marks), F.array(*ends)).otherwise(identity))


def start_states(rows: DataFrame, states: int, block: int = BLOCK) -> DataFrame:
    """path, pos, state: the state in which each line starts; the first one of a path starts in 0. rows: path, pos (from 0), f."""
    most = rows.agg(F.max("pos")).first()[0]
    return _scanned(rows.select("path", F.col("pos").cast("long").alias("pos"), "f"), most or 0, states, block)


def _scanned(rows: DataFrame, most: int, states: int, block: int) -> DataFrame:
    b = F.floor(F.col("pos") / block)
    blocks = rows.groupBy("path", b.alias("b")).agg(F.array_sort(F.collect_list(F.struct("pos", "f"))).alias("items"))
    if most < block:
        started = blocks.withColumn("s", F.lit(0))
    else:
        blocks = cut(blocks)
        identity = F.array(*[F.lit(i) for i in range(states)])
        whole = F.aggregate("items", identity, lambda acc, x: F.transform(acc, lambda s: F.get(x["f"], s)))
        above = _scanned(blocks.select("path", F.col("b").alias("pos"), whole.alias("f")), most // block, states, block)
        started = blocks.join(above.select("path", F.col("pos").alias("b"), F.col("state").alias("s")), ["path", "b"])
    none = F.array().cast("array<struct<pos:bigint,state:int>>")
    walk = F.aggregate("items", F.struct(none.alias("out"), F.col("s").alias("s")), lambda acc, x: F.struct(F.array_append(acc["out"], F.struct(x["pos"].alias("pos"), acc["s"].alias("state"))).alias("out"), F.get(x["f"], acc["s"]).alias("s")))
    return started.select("path", F.explode(walk["out"]).alias("o")).select("path", "o.pos", "o.state")


def masked_lines(files: DataFrame, style: Style | str = "go", content: str = "content", strings: bool = True, block: int = BLOCK) -> DataFrame:
    """path, line (from 1), text: every line as audit.lines has it, without comments and without strings that go over several lines.

    strings: text on one line stays; without it all text goes. A comment leaves nothing behind. A
    path names one file; files without a path or content have no lines. An empty file has one
    empty line.
    """
    style = STYLES[style] if isinstance(style, str) else style
    raw = files.where("path is not null").select("path", F.posexplode(F.split(F.col(content), "\n")).alias("pos", "raw"))
    states = start_states(line_functions(raw, style, "raw"), len(style.blocks) + 1, block) if style.blocks else None
    clean = _cleaned(F.col("raw"), style, strings)
    if states is not None:
        inside = cut(states.where("state > 0").select("path", F.col("pos").cast("int").alias("pos"), "state"))
        raw = raw.join(F.broadcast(inside) if inside.count() <= BROADCAST_LINES else inside, ["path", "pos"], "left")
        for i, b in enumerate(style.blocks, 1):
            clean = F.when(F.col("state") == i, F.coalesce(_cleaned(_after(F.col("raw"), b), style, strings), F.lit(""))).otherwise(clean)
    return raw.select("path", (F.col("pos") + 1).alias("line"), F.regexp_replace(clean, r"^[ \t\r\f]+|[ \t\r\f]+$", "").alias("text"))
