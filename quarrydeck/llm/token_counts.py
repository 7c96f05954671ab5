"""Token counts with a whole-token shortcut.

A text is cut at places that no merge of the vocabulary can cross: before each run of
spaces and at each line feed (``prove_cuts`` checks both facts on the vocabulary itself).
What lies between two cuts is a pre-token. ``whole_tokens`` proves once, before counting,
which vocabulary strings encode alone as exactly one token; a pre-token among these counts
one, and only the others are merged, each once per worker while it stays in a bounded memo.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import ship_code, table, tokenizer_path

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
#: Entries of a worker's memo of merged pre-tokens; when full it starts anew.
MEMO = 400_000

_PRETOKENS = re.compile(r"\n[^ \n]*| +[^ \n]*")


@cache
def _model(name: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))


def prove_cuts(name: str = MODEL) -> bool:
    """True if no piece holds a space mark after another character, nor a line feed: the cuts lose no merge."""
    sp = _model(name)
    pieces = (sp.id_to_piece(i) for i in range(sp.get_piece_size()))
    return not any(re.search("[^▁]▁|\n", p) for p in pieces)


def _merged(sp, key: str) -> int:
    """Tokens of one pre-token, by the library. Keys: "w" after one space, "\\nw" after a line feed, "" a lone space, "  w" after more spaces."""
    if key == "":
        return 1
    if key[0] == "\n":
        return len(sp.encode(key)) - 1  # the library puts a space mark first, which no merge joins to a line feed
    return len(sp.encode(key[1:] if key[0] == " " else key))


@cache
def whole_tokens(name: str = MODEL) -> frozenset[str]:
    """The pre-token keys that are one token, each proved with the library."""
    sp = _model(name)
    texts = []
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)):
            text = sp.id_to_piece(i).replace("▁", " ")
            if text.startswith(" ") and len(text) > 1:
                texts.append((i, text[1:] if text[1] != " " else text))
    return frozenset(key for i, key in texts if sp.encode(key[1:] if key[0] == " " else key) == [i])


class _Counts(dict):
    """Tokens by pre-token key: the proved whole tokens, and a bounded memo of merged ones."""

    def __init__(self, name: str, memo: int):
        self.sp, self.memo, self.whole = _model(name), memo, dict.fromkeys(whole_tokens(name), 1)
        super().__init__(self.whole)

    def __missing__(self, key: str) -> int:
        n = _merged(self.sp, key)
        if len(key) <= 64:
            if len(self) >= self.memo + len(self.whole):
                self.clear()
                self.update(self.whole)
            self[key] = n
        return n


def pretoken_keys(text: str) -> list[str]:
    """The pre-tokens of a text, as keys of _Counts."""
    text = " " + text.replace("▁", " ")
    if "  " not in text:
        return text.replace("\n", " \n").split(" ")[1:]
    return [x if x[0] == "\n" or x[:2] == "  " else x[1:] for x in _PRETOKENS.findall(text)]


@cache
def counter(name: str = MODEL, memo: int = MEMO) -> Callable[[str | None], int]:
    """A function that gives the tokens of a text; a model whose cuts aren't proved is asked for whole texts."""
    if not prove_cuts(name):
        sp = _model(name)
        return lambda text: len(sp.encode(text or ""))
    get = _Counts(name, memo).__getitem__
    return lambda text: sum(map(get, pretoken_keys(text))) if text else 0


def with_token_counts(df: DataFrame, text: str = "text", out: str = "n_tokens", model: str = MODEL, memo: int = MEMO) -> DataFrame:
    """df with a column ``out``: the tokens of column ``text`` without special tokens.

    Null and empty texts have 0. Rows keep their order and number; a column named ``out``
    that df already has is replaced. No shuffle, memory bounded by a batch and the memo.
    """
    ship_code(df.sparkSession)
    df = df.drop(out)
    schema = df.select("*", F.lit(0).cast("long").alias(out)).schema

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(model, memo)
        for b in batches:
            n = [of(t) for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n, pa.int64())], names=[*b.schema.names, out])

    return df.mapInArrow(count, schema)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every whole text of documents: doc_id, n_bytes, n_tokens, over_limit. Null texts count as empty; repeated rows stay."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_token_counts(docs).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > LIMIT).alias("over_limit"),
    )
