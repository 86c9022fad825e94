"""Language identification by unigrams over all segmentations.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces, found by a forward algorithm; a text's is the product over its words. The pieces are those of
a SentencePiece file that are lower-case letters, with or without the mark of a word's start, and one piece that stands for any single
letter which the file doesn't have. The probabilities are fitted by expectation maximisation: Spark counts (lang, word) over
every training row, and each round sums expected piece counts over that table. The table gathered to the driver is the model itself:
languages times pieces, of which MAX_LANGS bounds the first and the vocabulary the second.

Words are maximal runs of letters of the lower-cased text; a run of more than MAX_WORD letters is read as consecutive words. Workers hold words by a
64-bit hash.

Nulls and the like: a training row with null text, null lang or no letter teaches nothing. A text that is null or
has no letter is `und` with score 0, and so is every text where no language could be learned. Ties go to the language that sorts first.
Repeated rows count as often as they stand there. Columns other than those named play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stash
from .lattice import Lattice
from .wordhash import Hasher, Remembered, codes_of

VOCABULARY = "piece_bpe_32k.model"
MAX_WORD = 30
MAX_LANGS = 500
ROUNDS = 3
#: Added to every expected count, so that a piece which a language never used isn't impossible in it.
SMOOTHING = 0.01
#: Words that a worker remembers, and letters that it takes at a time.
REMEMBERED, LETTERS = 300_000, 1_000_000
MARK = "▁"

def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def pieces(path: str | None = None) -> list[str]:
    """The pieces in order of their ids in the file; number 0 is the single unknown letter."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path())
    found = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [""] + [p for p in found if (p.removeprefix(MARK).isalpha() or p == MARK) and p == p.lower()]


class Words:
    """The words of many texts: their hashes and places in the joined lower-cased text, and how many each text has."""

    def __init__(self):
        self.hasher = Hasher()
        self.letter = np.array([chr(i).isalpha() for i in range(0x110000)])

    def __call__(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        low = [(t or "").lower() for t in texts]
        joined = " ".join(low) + " "
        codes = codes_of(joined)
        change = np.diff(self.letter[codes].astype(np.int8), prepend=0)
        starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        long = np.flatnonzero(ends - starts > MAX_WORD)
        if len(long):
            more = [np.arange(starts[i] + MAX_WORD, ends[i], MAX_WORD) for i in long]
            starts, ends = np.sort(np.concatenate([starts, *more])), np.sort(np.concatenate([ends, *more]))
        limits = np.cumsum([len(t) + 1 for t in low])
        counts = np.diff(np.searchsorted(starts, limits), prepend=0)
        return joined, starts, ends, self.hasher(codes, starts, ends), counts


def marked(words: list[str]) -> list[str]:
    return [MARK + w for w in words]


@lru_cache(maxsize=1)
def _tools(path: str | None) -> tuple[Lattice, Words]:
    """A worker makes them once."""
    return Lattice(pieces(path)), Words()


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, int, list]]:
    """Batches in pieces of a bounded number of letters (or one text): the batch, the first row, the texts."""
    for b in batches:
        part, size, first = [], 0, 0
        for i, x in enumerate(b.column(column)):
            t = x.as_py()
            part.append(t)
            size += len(t or "")
            if size >= LETTERS:
                yield b, first, part
                part, size, first = [], 0, i + 1
        if part:
            yield b, first, part


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over every row; counted in the workers before rows are dealt out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        _, words = _tools(None)

        def out() -> pa.RecordBatch:
            langs, said = zip(*seen, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(langs), pa.array(said), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

        for b, first, texts in _texts(batches, 1):
            by_lang: dict[str, list] = {}
            for lang, text in zip(b.column(0).slice(first, len(texts)).to_pylist(), texts, strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, own in by_lang.items():
                joined, starts, ends, hashes, _ = words(own)
                _, at, counts = np.unique(hashes, return_index=True, return_counts=True)
                for i, j, n in zip(starts[at].tolist(), ends[at].tolist(), counts.tolist(), strict=True):
                    seen[lang, joined[i:j]] += n
            if len(seen) >= REMEMBERED:
                yield out()
                seen.clear()
        if seen:
            yield out()

    rows = docs.where("lang IS NOT NULL AND text IS NOT NULL").select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, path: str | None = None, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """The languages in order, and the probabilities by (piece, language). Every row of docs with text and lang counts."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    table = stash(word_counts(docs), "words")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20000")
    langs = sorted(r.lang for r in table.select("lang").distinct().limit(MAX_LANGS + 1).collect())
    if len(langs) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    n = len(pieces(path))
    p = np.full((n, len(langs)), 1 / n)
    for _ in range(rounds if langs else 0):
        sent = spark.sparkContext.broadcast((path, langs, p))

        def expect(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            path, langs, p = sent.value
            lattice, total, place = _tools(path)[0], np.zeros(p.shape), {x: i for i, x in enumerate(langs)}
            for b in batches:
                lang = np.array([place[x] for x in b.column(0).to_pylist()])
                words, counts = b.column(1).to_pylist(), b.column(2).to_numpy()
                for i in np.unique(lang):
                    own = np.flatnonzero(lang == i)
                    total[:, i] += lattice.expected(marked([words[j] for j in own]), counts[own].astype(float), p[:, i])
            piece, i = np.nonzero(total)
            if len(piece):
                yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(total[piece, i])], names=["piece", "i", "n"])

        found = table.mapInArrow(expect, "piece int, i int, n double").groupBy("piece", "i").agg(F.sum("n").alias("n")).toArrow()
        p = np.full(p.shape, SMOOTHING)
        p[found["piece"].to_numpy(), found["i"].to_numpy()] += found["n"].to_numpy()
        p /= p.sum(axis=0)
        sent.unpersist()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return langs, p


def choose(total: np.ndarray, langs: list[str]) -> tuple[str, float]:
    """The label and score of a text, from its log probability by language."""
    best = int(np.argmax(total))
    return langs[best], float(round(1 / np.exp(np.maximum(total - total[best], -700)).sum(), 6))


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], path: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry, lang_pred and score (the language's share of the total probability) of every row."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((path, *model))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, langs, p = sent.value
        (lattice, words), known = _tools(path), Remembered(REMEMBERED)
        table = np.zeros((0, len(langs)))
        for b, first, texts in _texts(batches, 0):
            joined, starts, ends, hashes, counts = words(texts)
            distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
            if known.full(len(distinct)):
                known.clear()
                table = table[:0]
            found = known.find(distinct)
            new = np.flatnonzero(found < 0)
            if len(new) and langs:
                said = [joined[i:j] for i, j in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
                more = np.concatenate([lattice.scores(marked(said[i : i + 20_000]), p) for i in range(0, len(said), 20_000)])
                found[new] = len(table) + np.arange(len(new))
                known.add(distinct[new], found[new])
                table = np.concatenate([table, more])
            labels, scores = ["und"] * len(texts), [0.0] * len(texts)
            if len(hashes) and langs:
                some = np.flatnonzero(counts)
                totals = np.add.reduceat(table[found[back]], (np.cumsum(counts) - counts)[some], axis=0)
                for i, total in zip(some.tolist(), totals, strict=True):
                    labels[i], scores[i] = choose(total, langs)
            rest = [b.column(i + 1).slice(first, len(texts)) for i in range(len(carry))]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(labels, pa.string()), pa.array(scores, pa.float64())], names=[*carry, "lang_pred", "score"])

    rows = docs.select(F.col("text").cast("string").alias("_text"), *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(label, f"{kinds}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves 0 by 5; rows with no id are never held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))
