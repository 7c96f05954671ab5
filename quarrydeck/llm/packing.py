"""Cost-balanced packing of documents into token sequences.

Each document has a cost ``linear * n + quadratic * n * n`` (attention grows with the square
of its length). Within a group of documents that one task holds, pieces are taken in
descending length and each goes to the sequence of lowest cost that still has room for it.
What fits nowhere is cut over the room that is left, and what exceeds whole sequences goes on
into the task's next group, so that sequences are full. A task's last tokens, fewer than one
sequence, become sequences whose lengths are powers of two, which need no padding.

A task holds at most one group (``group`` sequences) and one batch. No shuffle; a lost task is
run again from its input and gives the same sequences.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import ship_code, table, tokenizer_path

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
CAPACITY = 4096
GROUP = 256
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: Entries of one of the two generations of a worker's memo of encoded words, which outlives its tasks (some 15 MB each).
MEMO = 60_000

#: Characters for which the short cut splits as the tokenizer does: ASCII without the separators that only Python takes for white space, and Latin letters up to U+024F without the one that lower-cases to two characters.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-ÖØ-öø-įı-ɏ]*")
_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class _Chunks(dict):
    """Ids, as bytes (unsigned 32-bit, little-endian), of what stands between white space in a plain text.

    The library's model encodes each word once. When the memo is full it becomes the older
    generation, which still answers (and hands back what is asked for) until the next is full.
    """

    def __init__(self, tokenizer, memo: int):
        super().__init__()
        from tokenizers import pre_tokenizers

        self.tokenize, self.memo, self.older = tokenizer.model.tokenize, memo, {}
        # the library's own form of each character's UTF-8 bytes
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.table = {ord(c): to_bytes(c)[0][0] for k in range(0x250) if _PLAIN.fullmatch(chr(k)) for c in chr(k).lower() if not c.isspace()}

    def __missing__(self, chunk: str) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            words = (chunk,) if chunk.isalpha() else _WORDS.findall(chunk)
            if len(words) == 1 and words[0] == chunk:
                ids = array("I", [t.id for t in self.tokenize(chunk if chunk.isascii() and chunk.isalpha() else chunk.translate(self.table))]).tobytes()
            else:
                ids = b"".join(map(self.__getitem__, words))
        if len(chunk) <= 64:
            if len(self) >= self.memo:
                self.older = dict(self)
                self.clear()
            self[chunk] = ids
        return ids


@cache
def encoder(name: str = TOKENIZER, memo: int = MEMO) -> Callable[[str | None], bytes]:
    """A function that gives the ids of a text, as bytes, as the library has them.

    The tokenizer drops white space, lower-cases, and merges within words only. A plain text
    is thus the join of its words, each encoded by the library's model once and kept in a
    bounded memo. Any other text (other scripts, combining marks, special tokens) goes to the
    library whole.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path(name))
    chunk = _Chunks(tokenizer, memo).__getitem__

    def ids(text: str | None) -> bytes:
        if not text:
            return b""
        if "<|" in text or not _PLAIN.fullmatch(text):
            return array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(chunk, text.lower().split()))

    return ids


class Packer:
    """Packs documents, given one after another, into sequences."""

    def __init__(self, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC):
        self.capacity, self.linear, self.quadratic = capacity, linear, quadratic

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def pack(self, pieces: list[tuple[int, int, int]]) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int, int]]]:
        """Full sequences, and the pieces left over (less than one sequence). A piece: (document, start, length)."""
        cap = self.capacity
        full, rest = [], []
        for doc, start, n in pieces:
            while n >= cap:
                full.append([(doc, start, cap)])
                start, n = start + cap, n - cap
            if n:
                rest.append((doc, start, n))
        rest.sort(key=lambda p: (-p[2], p[0], p[1]))
        n_seq = sum(p[2] for p in rest) // cap
        if not n_seq:
            return full, rest
        sequences: list[list[tuple[int, int, int]]] = [[] for _ in range(n_seq)]
        costs, room, later = np.zeros(n_seq), np.full(n_seq, cap), []
        for p in rest:
            fits = room >= p[2]
            if fits.any():
                k = int(np.where(fits, costs, np.inf).argmin())
                sequences[k].append(p)
                costs[k] += self.cost(p[2])
                room[k] -= p[2]
            else:
                later.append(p)
        open_ = [int(k) for k in np.argsort(costs, kind="stable") if room[k]]
        left = []
        for doc, start, n in later:  # cut over the room that is left, lowest cost first
            while n and open_:
                k = open_[0]
                take = min(n, int(room[k]))
                sequences[k].append((doc, start, take))
                room[k] -= take
                start, n = start + take, n - take
                if not room[k]:
                    open_.pop(0)
            if n:
                left.append((doc, start, n))
        return full + sequences, left

    def tail(self, pieces: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
        """The last pieces as sequences whose lengths are powers of two."""
        left, out, queue = sum(p[2] for p in pieces), [], list(reversed(pieces))
        while left:
            want = 1 << (left.bit_length() - 1)
            left -= want
            seq = []
            while want:
                doc, start, n = queue.pop()
                take = min(n, want)
                seq.append((doc, start, take))
                want -= take
                if n > take:
                    queue.append((doc, start + take, n - take))
            out.append(seq)
        return out


def packed(df: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY, group: int = GROUP, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece of a document: where it starts in its document, its sequence and its place there.

    Null and empty texts are documents of the end id alone. Repeated rows are documents of
    their own. Other columns of df are ignored. An empty df gives no rows.
    """
    ship_code(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer, end = encoder(tokenizer), Packer(capacity, linear, quadratic), array("I", [end_id]).tobytes()
        context = TaskContext.get()
        next_id = (context.partitionId() if context else 0) << 40
        docs: dict[int, tuple[int | None, bytes]] = {}
        pieces: list[tuple[int, int, int]] = []
        held = serial = 0

        def rows(sequences: list[list[tuple[int, int, int]]]) -> pa.RecordBatch:
            nonlocal next_id
            cols: list[list] = [[] for _ in range(7)]
            for seq in sequences:
                offset = 0
                for doc, start, n in seq:
                    key, ids = docs[doc]
                    for col, v in zip(cols, (key, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, next_id, offset), strict=True):
                        col.append(v)
                    offset += n
                next_id += 1
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)

        for b in batches:
            for key, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = encode(t) + end
                docs[serial] = (key, ids)
                pieces.append((serial, 0, len(ids) // 4))
                held += len(ids) // 4
                serial += 1
                if held >= group * capacity:
                    sequences, pieces = packer.pack(pieces)
                    yield rows(sequences)
                    docs = {p[0]: docs[p[0]] for p in pieces}
                    held = sum(p[2] for p in pieces)
        sequences, pieces = packer.pack(pieces)
        sequences += packer.tail(pieces)
        if sequences:
            yield rows(sequences)

    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(run, SCHEMA)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens: one row per piece."""
    return packed(table(spark, sf_dir, "documents"))
