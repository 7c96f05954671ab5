"""Language identification by segmentation-marginalised unigrams.

Every language has a probability for each piece of one fixed public vocabulary. The
probability of a word (a run of letters) is the sum over all its segmentations into pieces, which
a forward pass over the word's characters gives; the log-probability of a text is the sum over its
words. Characters in no piece count as one unknown piece each. Sums of long words are rescaled as
they go, so that words of any length have their exact value.

Piece probabilities are fitted with EM (forward-backward over all segmentations) to the word
counts of each language, which Spark counts in a bounded sample of labelled documents. Scoring
covers every word of every text; a word's scores are computed once per worker while it stays in a
bounded memo.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import ship_code, table, tokenizer_path

MODEL = "piece_bpe_32k.model"
#: Labelled documents of each language that are fitted to (about, and twice as many at most; chosen by hash).
SAMPLE = 800
ROUNDS = 3
#: Words in one of the two generations of a worker's memo.
MEMO = 60_000
#: Characters of a fit's words, and of a worker's, that are in one table of segmentations at a time.
FIT_CELLS, CELLS = 200_000, 50_000
#: Code points of the texts whose words a worker holds at a time (or one text).
HELD = 500_000
#: Positions after which sums are rescaled, and the word length up to which they need not be.
RESCALE, SHORT = 8, 16

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    """Runs of letters (characters of Unicode's category L), lower-cased."""
    found = _WORD.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    # letter-like numbers (fractions, Roman numerals, digits in circles) are no letters
    return "".join(c if c.isalpha() else " " for w in found for c in (*w, " ")).split()


@cache
def vocabulary(name: str = MODEL) -> tuple[str, ...]:
    """The pieces of the vocabulary, a space mark as a leading underscore, lower-cased, without repeats."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    pieces = (sp.id_to_piece(i).replace("▁", "_").lower() for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i)))
    return tuple(sorted({p for p in pieces if re.fullmatch(r"_?[^\W\d_]*", p) and p}))


class Segments:
    """The segmentations of batches of words, as index tables for vectorised forward and backward passes.

    Row ``len(pieces)`` of a probability table is the unknown piece (one character that is no
    piece), the row after it is no piece at all and has probability 0.
    """

    def __init__(self, pieces: tuple[str, ...]):
        self.index = {p: k for k, p in enumerate(pieces)}
        self.unknown, self.none = len(pieces), len(pieces) + 1
        self.longest = max(map(len, pieces), default=1)
        # the pieces' prefixes as nodes; a step from a node by a character is one number, and steps are looked up in a sorted array
        nodes = {"": 0}
        for p in pieces:
            for j in range(1, len(p) + 1):
                nodes.setdefault(p[:j], len(nodes))
        self.letters = np.array(sorted({ord(c) for p in pieces for c in p}), np.uint32)
        place = {chr(c): k for k, c in enumerate(self.letters.tolist())}
        steps = sorted((nodes[x[:-1]] * len(place) + place[x[-1]], k) for x, k in nodes.items() if x)
        self.steps, self.to = np.array([x for x, _ in steps], np.int64), np.array([k for _, k in steps], np.int64)
        self.piece = np.array([self.index.get(x, self.none) for x in nodes], np.int32)

    def _table(self, words: list[str], n: int) -> np.ndarray:
        """The pieces of words of n - 1 characters each."""
        table = np.full((len(words), n, self.longest), self.none, np.int32)
        if len(self.steps):
            codes = np.frombuffer("".join("_" + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
            letter = np.where(self.letters[at] == codes, at, -1)
            start = np.arange(len(codes))
            left = n - start % n  # characters from here to the word's end
            node, flat = np.zeros(len(codes), np.int64), table.reshape(len(codes), self.longest)
            for m in range(self.longest):
                ok = left > m
                start, left, node = start[ok], left[ok], node[ok]
                c = letter[start + m]
                step = node * len(self.letters) + c
                k = np.minimum(np.searchsorted(self.steps, step), len(self.steps) - 1)
                ok = (c >= 0) & (self.steps[k] == step)
                start, left, node = start[ok], left[ok], self.to[k[ok]]
                if not len(start):
                    break
                flat[start, m] = self.piece[node]
        first = table[:, :, 0]
        first[first == self.none] = self.unknown
        return table

    def tables(self, words: list[str], cells: int = FIT_CELLS) -> Iterator[tuple[list[int], np.ndarray]]:
        """Positions of the words of one length, and their pieces by (word, start, piece length - 1), for about ``cells`` characters at a time."""
        by: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by.setdefault(len(w) + 1, []).append(k)
        for n, at in sorted(by.items()):
            most = max(1, cells // n)
            for part in (at[k : k + most] for k in range(0, len(at), most)):
                yield part, self._table([words[k] for k in part], n)

    def forward(self, table: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the first i characters in each language, as a number and the logarithm of its scale: (word, i, language) each."""
        w, n, longest = table.shape
        alpha, scale = np.zeros((w, n + 1, p.shape[1])), np.zeros((w, n + 1, p.shape[1]))
        alpha[:, 0] = 1
        for i in range(n):
            if n > SHORT and i and i % RESCALE == 0:
                # all sums that are still to be added to go over to the same new scale
                top = alpha[:, i : i + longest].max(axis=1)
                top[top == 0] = 1
                alpha[:, i : i + longest] /= top[:, None]
                scale[:, i:] += np.log(top)[:, None]
            for m in range(min(longest, n - i)):
                k = table[:, i, m]
                if m and (k == self.none).all():
                    continue
                alpha[:, i + m + 1] += alpha[:, i] * p[k]
        return alpha, scale

    def backward(self, table: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability of the characters from i on in each language, likewise."""
        w, n, longest = table.shape
        beta, scale = np.zeros((w, n + 1, p.shape[1])), np.zeros((w, n + 1, p.shape[1]))
        beta[:, n] = 1
        for i in range(n - 1, -1, -1):
            for m in range(min(longest, n - i)):
                k = table[:, i, m]
                if m and (k == self.none).all():
                    continue
                beta[:, i] += beta[:, i + m + 1] * p[k]
            if n > SHORT and i and i % RESCALE == 0:
                part = beta[:, i : i + longest]
                top = part.max(axis=1)
                top[top == 0] = 1
                part /= top[:, None]
                scale[:, i : i + longest] += np.log(top)[:, None]
                scale[:, :i] = scale[:, i : i + 1]
        return beta, scale

    def logs(self, table: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Log-probability of whole words in each language."""
        alpha, scale = self.forward(table, p)
        return np.log(alpha[:, -1]) + scale[:, -1]


class Scorer:
    """Log-probabilities of words in each language, summed over all their segmentations, with a bounded memo of two generations."""

    def __init__(self, pieces: tuple[str, ...], p: np.ndarray, memo: int = MEMO):
        self.segments, self.memo = Segments(pieces), memo
        self.p = np.vstack([p, np.zeros((1, p.shape[1]))])
        self.at: dict[str, int] = {}
        self.values = np.zeros((0, p.shape[1]))
        self.older = (self.at, self.values)

    def learn(self, words: set[str]) -> None:
        """Score the words that the memo lacks; when it is full it becomes the older generation."""
        if len(self.at) > self.memo:
            self.older, self.at, self.values = (self.at, self.values), {}, self.values[:0]
        new = [w for w in words if w not in self.at]
        if not new:
            return
        at, values = self.older
        known = np.array([at.get(w, -1) for w in new])
        out = np.zeros((len(new), self.p.shape[1]))
        out[known >= 0] = values[known[known >= 0]]
        fresh = np.nonzero(known < 0)[0]
        for positions, table in self.segments.tables([new[k] for k in fresh], CELLS):
            out[fresh[positions]] = self.segments.logs(table, self.p)
        self.at.update(zip(new, range(len(self.values), len(self.values) + len(new)), strict=True))
        self.values = np.vstack([self.values, out])

    def score(self, words: list[str]) -> np.ndarray:
        """The sum over the words of a text, all of which were learned."""
        return self.values[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)


def fit(counts: dict[str, dict[str, int]], pieces: tuple[str, ...] | None = None, rounds: int = ROUNDS) -> tuple[list[str], tuple[str, ...], np.ndarray]:
    """Languages, the pieces that occur, and their probabilities (pieces and the unknown piece, by language), by EM over all segmentations.

    counts: words of each language with their counts.
    """
    segments = Segments(vocabulary() if pieces is None else pieces)
    pieces, langs = tuple(segments.index), sorted(counts)
    start = np.array([0.05 ** len(x) for x in pieces] + [0.05, 0])  # doesn't favour long pieces
    fitted = []
    for lang in langs:
        ws = list(counts[lang])
        weight = np.array([counts[lang][w] for w in ws], float)
        tables = list(segments.tables(ws))
        p = (start / start.sum())[:, None]
        for _ in range(rounds):
            expect = np.zeros(len(p))
            for at, table in tables:
                (a, sa), (b, sb) = segments.forward(table, p), segments.backward(table, p)
                n = table.shape[1]
                total = np.log(a[:, -1, 0]) + sa[:, -1, 0]
                for i in range(n):
                    for m in range(min(table.shape[2], n - i)):
                        k = table[:, i, m]
                        if m and (k == segments.none).all():
                            continue
                        share = weight[at] * np.exp(sa[:, i, 0] + sb[:, i + m + 1, 0] - total)
                        expect += np.bincount(k, share * a[:, i, 0] * p[k, 0] * b[:, i + m + 1, 0], len(p))
            p = expect[:, None].copy()
            p[-1] = 0
            p = p / max(p.sum(), 1e-300)
            p[segments.unknown] = max(p[segments.unknown], 1e-12)  # a character that no piece has stays possible
        fitted.append(expect)
    counted = np.stack(fitted, axis=1)
    used = np.nonzero(counted[:-2].sum(axis=1) > 1e-6)[0]
    smooth = counted[[*used, segments.unknown]] + 0.05
    return langs, tuple(pieces[k] for k in used), smooth / smooth.sum(axis=0)


def training_counts(df: DataFrame, text: str, lang: str, key: str, sample: int = SAMPLE) -> dict[str, dict[str, int]]:
    """Word counts of each language over about ``sample`` labelled documents of each (of at most twice as many), whole, chosen by hashed key and text.

    Equal rows count once. All languages that have a labelled document take part; these are few
    by nature, and so are the distinct words of the sample, which Spark counts.
    """
    labelled = df.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("t"), F.xxhash64(F.col(key), F.col(text)).alias("h"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()}
    if not sizes:
        return {}
    # in place of a share of rows, a bound for hashes, which doesn't round to nothing
    share = F.lit(0.0)
    for name, n in sizes.items():
        share = F.when(F.col("lang") == name, F.lit(1.0 if n <= 1.5 * sample else sample / n)).otherwise(share)
    u = F.shiftrightunsigned("h", 11) / float(1 << 53)
    few = labelled.where(u < share).dropDuplicates(["lang", "h"])
    chosen = few.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("place") <= 2 * sample)
    found = chosen.select("lang", F.explode(F.regexp_extract_all(F.lower("t"), F.lit(r"\p{L}+"), F.lit(0))).alias("w")).groupBy("lang", "w").count()
    counts: dict[str, dict[str, int]] = {}
    for r in found.toLocalIterator():
        counts.setdefault(r["lang"], {})[r["w"]] = r["count"]
    return {k: dict(sorted(c.items())) for k, c in counts.items()}


def _slices(texts: list[str | None], held: int) -> Iterator[list[str | None]]:
    """The texts in order, in lists of ``held`` code points at most or of one text."""
    part, n = [], 0
    for t in texts:
        if part and n + len(t or "") > held:
            yield part
            part, n = [], 0
        part.append(t)
        n += len(t or "")
    if part:
        yield part


def with_language(df: DataFrame, model: tuple[list[str], tuple[str, ...], np.ndarray], text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the predicted language and its posterior (0 to 1).

    Texts that are null or have no letter, and all texts if the model knows no language, get
    ``und`` and 0. The posterior takes a uniform prior and counts each text as at most 64 words
    of average likelihood, as words aren't independent. Columns of these names are replaced.
    """
    spark = ship_code(df.sparkSession)
    df = df.drop(lang_out, score_out)
    schema = df.select("*", F.lit("").alias(lang_out), F.lit(0.0).alias(score_out)).schema
    held = spark.sparkContext.broadcast(model)  # at most the vocabulary's pieces by the languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, pieces, p = held.value
        scorer = Scorer(pieces, p)
        for b in batches:
            preds, scores = [], []
            for part in _slices(b.column(b.schema.get_field_index(text)).to_pylist(), HELD):
                found = [words(t) if t and langs else [] for t in part]
                scorer.learn(set().union(*found))
                for ws in found:
                    if not ws:
                        preds.append("und")
                        scores.append(0.0)
                        continue
                    ll = scorer.score(ws) * min(1.0, 64 / len(ws))
                    k = int(ll.argmax())
                    preds.append(langs[k])
                    scores.append(float(1 / np.exp(np.minimum(ll - ll[k], 0)).sum()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], names=[*b.schema.names, lang_out, score_out])

    return df.mapInArrow(run, schema)


def learned(docs: DataFrame, sample: int = SAMPLE):
    """The model of the documents that aren't held out (crc32 of the id as text modulo 5 is not 0)."""
    rest = docs.where(~_held_out())
    counts = training_counts(rest, "text", "lang", "doc_id", sample)
    return fit(counts) if counts else ([], (), np.zeros((1, 0)))


def _held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document: doc_id, held_out, lang_pred, score."""
    docs = table(spark, sf_dir, "documents")
    model = learned(docs.select("doc_id", "text", "lang"))
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")
