"""SentencePiece encoding and decoding over a lattice of pieces.

A text is read as a SentencePiece file reads it: spaces become the mark ▁ and one mark is put before the text. It is cut into units that no
piece of the file reaches across (marks, then other characters; each newline and each literal ▁ by itself). The encoding of a
unit is the path through the lattice of its pieces with the largest sum of the file's scores; of equal paths that whose last
piece is longer, and so on back. A character that no piece covers stands for the pieces of its UTF-8 bytes, at UNKNOWN below the least score.

The lattice is relational for the units that make up most of a corpus, those of LEXICON highest counts: their substrings of bounded length are
exploded and equi-joined to the piece table, edges are grouped by unit, and a higher-order aggregate folds the best path. That
lexicon is bounded by LEXICON units and is broadcast. The documents are then encoded where they stand; units that the lexicon doesn't
have go through the same lattice in the worker (lattice.Lattice.best), which remembers a bounded number of them. So a document is
never exploded and never shuffled, and the result doesn't depend on what the lexicon holds.

The files' scores decide here, not the order of merges: for a file of kind BPE the pieces can differ from those of its own
encoder; decoding gives the text back exactly either way.

Nulls, empties, ties: a null text has null ids and pieces; an empty text has none (no mark is put before it). A text of any length
is encoded whole. Rows may repeat and ids may be null: each row is encoded by itself. Other columns play no part. Empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stash
from .lattice import Lattice
from .wordhash import Hasher, Remembered, codes_of

VOCABULARY = "piece_bpe_32k.model"
MARK = "▁"
UNKNOWN = 10.0
#: Units in the broadcast lexicon at most, and the longest of them. Longer units are encoded in the workers.
LEXICON, LONGEST_UNIT = 50_000, 40
#: Units that a worker remembers, and characters that it takes at a time.
REMEMBERED, CHARACTERS = 300_000, 1_000_000
#: Literal marks are kept from the text's spaces by a place of their own.
_UNIT = re.compile(f"\n|{MARK}| *[^ \n{MARK}]+| +")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


class Vocabulary:
    """The pieces of a file with ids and scores, without its control pieces, and the ids of bytes."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path())
        every = range(model.get_piece_size())
        self.bytes = {int(model.id_to_piece(i)[1:-1], 16): i for i in every if model.is_byte(i)}
        self.ids = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.pieces = [model.id_to_piece(i) for i in self.ids]
        self.scores = [model.get_score(i) for i in self.ids]
        if len(self.bytes) != 256 or not all(re.fullmatch(f"{MARK}*[^{MARK}]*", p) for p in self.pieces):
            raise ValueError("the file has no bytes to fall back on, or pieces with a mark inside")
        self.unknown = min(self.scores) - UNKNOWN
        self.size = model.get_piece_size()

    def byte_ids(self, character: str) -> list[int]:
        return [self.bytes[b] for b in character.encode("utf-8", "surrogatepass")]

    def table(self, spark: SparkSession) -> DataFrame:
        """(piece, id, score)"""
        return spark.createDataFrame(pa.table({"piece": self.pieces, "id": pa.array(self.ids, pa.int32()), "score": pa.array(self.scores, pa.float64())}))


@lru_cache(maxsize=2)
def _loaded(path: str | None) -> tuple[Vocabulary, Lattice, np.ndarray]:
    v = Vocabulary(path)
    return v, Lattice(["", *v.pieces]), np.array([v.unknown, *v.scores])


def units(text: str) -> list[str]:
    """The units of a text, spaces not yet marks; a literal ▁ is a unit. Joined they are the text with one space before it."""
    return _UNIT.findall(" " + text) if text else []


def _marked(unit: str) -> str:
    return unit.replace(" ", MARK)


def encode_units(some: list[str], path: str | None = None) -> list[list[int]]:
    """The ids of each unit, by the lattice over all of them at once."""
    v, lattice, scores = _loaded(path)
    out: list[list[int]] = [[] for _ in some]
    plain = [i for i, u in enumerate(some) if u != MARK]
    for i in set(range(len(some))).difference(plain):
        out[i] = v.byte_ids(MARK)
    if plain:
        marked = [_marked(some[i]) for i in plain]
        found, at = lattice.best(marked, scores)
        ids = [0, *v.ids]
        for j, i in enumerate(plain):
            own = found[at[j] : at[j + 1]].tolist()
            if 0 in own:
                place = 0
                for p in own:
                    out[i] += v.byte_ids(marked[j][place]) if p == 0 else [ids[p]]
                    place += 1 if p == 0 else len(v.pieces[p - 1])
            else:
                out[i] = [ids[p] for p in own]
    return out


def decode_ids(ids: list[int] | None, path: str | None = None) -> str | None:
    """The text of ids; ids of control pieces stand for nothing."""
    if ids is None:
        return None
    text = b"".join(map(_spelled(path).__getitem__, ids)).decode("utf-8", "surrogatepass")
    return text[1:] if text[:1] == " " else text


@lru_cache(maxsize=2)
def _spelled(path: str | None) -> list[bytes]:
    v = _loaded(path)[0]
    spelled = [b""] * v.size
    for i, p in zip(v.ids, v.pieces, strict=True):
        spelled[i] = p.replace(MARK, " ").encode("utf-8", "surrogatepass")
    for b, i in v.bytes.items():
        spelled[i] = bytes([b])
    return spelled


class Units:
    """The units of many texts at once: hashes, and places in the joined texts, each with one space before it and a newline after."""

    def __init__(self):
        self.hasher = Hasher()

    def __call__(self, texts: list[str | None]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        joined = "".join(f" {t}\n" if t else "\n" for t in texts)
        codes = codes_of(joined)
        alone, space = (codes == 10) | (codes == ord(MARK)), codes == 32
        begins = alone | space
        begins[1:] = alone[1:] | alone[:-1] | (space[1:] & ~space[:-1])
        starts = np.flatnonzero(begins)
        ends = np.r_[starts[1:], len(codes)]
        limits = np.cumsum([len(t) + 2 if t else 1 for t in texts])
        # The newline after each text is no unit of it.
        last = np.searchsorted(starts, limits) - 1
        keep = np.ones(len(starts), bool)
        keep[last] = False
        counts = np.diff(last, prepend=-1) - 1
        starts, ends = starts[keep], ends[keep]
        return joined, starts, ends, self.hasher(codes, starts, ends), counts


@lru_cache(maxsize=1)
def _units() -> Units:
    return Units()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list]]:
    """Batches in pieces of a bounded number of characters (or one text): the batch, the first row, the texts."""
    for b in batches:
        part, size, first = [], 0, 0
        for i, x in enumerate(b.column(0)):
            part.append(x.as_py())
            size += len(part[-1] or "")
            if size >= CHARACTERS:
                yield b, first, part
                part, size, first = [], 0, i + 1
        if part:
            yield b, first, part


def unit_counts(docs: DataFrame) -> DataFrame:
    """(unit, n) over every text, counted in the workers before units are dealt out; units longer than LONGEST_UNIT are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])
        for _, _, texts in _parts(batches):
            joined, starts, ends, hashes, _ = _units()(texts)
            _, at, counts = np.unique(hashes, return_index=True, return_counts=True)
            for i, j, n in zip(starts[at].tolist(), ends[at].tolist(), counts.tolist(), strict=True):
                if j - i <= LONGEST_UNIT:
                    seen[joined[i:j]] += n
            if len(seen) >= REMEMBERED:
                yield out()
                seen.clear()
        if seen:
            yield out()

    return docs.select(F.col("text").cast("string")).mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int = LEXICON) -> DataFrame:
    """The units of highest counts, at most so many: those above a step of the counts' logarithms. No sort, no gathering of counts."""
    stepped = counts.withColumn("step", F.expr("CAST(floor(log2(n) * 8) AS INT)"))
    steps = stepped.groupBy("step").agg(F.count("*").alias("units")).collect()  # 512 rows at most
    total, least = 0, 1 << 30
    for step, n in sorted(map(tuple, steps), reverse=True):
        total += n
        if total > most:
            break
        least = step
    return stepped.where(F.col("step") >= least).select("unit")


def lexicon(some: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, path: array of ids) for distinct units of bounded length. An unknown character stands as -1 less its code point."""
    longest = max(map(len, vocabulary.pieces))
    marked = some.where(f"unit <> '{MARK}'").withColumn("marked", F.translate("unit", " ", MARK))
    places = marked.select("unit", "marked", F.explode(F.expr("sequence(0, length(marked) - 1)")).alias("start"))
    cuts = places.select("unit", "start", F.explode(F.expr(f"transform(sequence(1, least({longest}, length(marked) - start)), k -> struct(start + k AS end, substring(marked, start + 1, k) AS piece))")).alias("c"))
    edges = cuts.select("unit", "start", "c.end", "c.piece").join(F.broadcast(vocabulary.table(some.sparkSession)), "piece", "left")
    edges = edges.withColumns({"score": F.expr(f"coalesce(score, IF(end = start + 1, {vocabulary.unknown}D, NULL))"), "id": F.expr("coalesce(id, -1 - ascii(piece))")}).where("score IS NOT NULL")
    grouped = edges.groupBy("unit").agg(F.collect_list(F.struct("end", "start", "score", "id")).alias("edges"), F.max("end").alias("n"))
    # best[i]: the sum, place before and piece of the best path to place i; ties go to the smaller start.
    fold = """aggregate(sequence(1, n), array(named_struct('total', 0D, 'back', 0, 'id', 0)),
        (best, i) -> concat(best, array(array_max(transform(filter(edges, e -> e.end = i),
            e -> named_struct('total', best[e.start].total + e.score, 'back', -e.start, 'id', e.id))))))"""
    trace = """aggregate(sequence(n, 1, -1), named_struct('at', n, 'path', CAST(array() AS array<int>)),
        (s, i) -> IF(s.at = i, named_struct('at', -best[i].back, 'path', concat(array(best[i].id), s.path)), s)).path"""
    return grouped.select("unit", "n", F.expr(fold).alias("best")).select("unit", F.expr(trace).alias("path"))


def _append(flat: np.ndarray, at: np.ndarray, more: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    flat = np.concatenate([flat, np.fromiter((x for own in more for x in own), np.int32)])
    return flat, np.concatenate([at, at[-1] + np.cumsum([len(own) for own in more], dtype=np.int64)])


def _start(path: str | None, base: dict[str, list[int]]) -> tuple[Remembered, np.ndarray, np.ndarray]:
    """What a worker knows at first, the lexicon: numbers by hash, and the ids of each number in one row, with their limits."""
    known = Remembered(REMEMBERED + len(base))
    flat, at = np.zeros(0, np.int32), np.zeros(1, np.int64)
    if base:
        codes = codes_of("".join(base))
        ends = np.cumsum([len(u) for u in base])
        known.add(_units().hasher(codes, np.r_[0, ends[:-1]], ends), np.arange(len(base)))
        flat, at = _append(flat, at, list(base.values()))
    return known, flat, at


def _gathered(flat: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of these numbers, joined, and their lengths."""
    sizes = at[numbers + 1] - at[numbers]
    return flat[np.repeat(at[numbers] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))], sizes


def _same(ids: np.ndarray, limits: np.ndarray, texts: list[str | None], path: str | None) -> np.ndarray:
    """Whether the ids of each text spell it, with a space before it."""
    flat, at = _spelling(path)
    data, sizes = _gathered(flat, at, ids)
    ends = np.r_[0, np.cumsum(sizes)][limits]
    data = data.tobytes()
    return np.array([data[ends[i] : ends[i + 1]] == ((" " + t).encode("utf-8", "surrogatepass") if t else b"") for i, t in enumerate(texts)], bool)


@lru_cache(maxsize=2)
def _spelling(path: str | None) -> tuple[np.ndarray, np.ndarray]:
    spelled = _spelled(path)
    return np.frombuffer(b"".join(spelled), np.uint8), np.r_[0, np.cumsum([len(s) for s in spelled])]


def encode(docs: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("doc_id",), size: int = LEXICON) -> DataFrame:
    """The columns of carry, ids array<int>, n_pieces long, and round_trip: whether the ids decode to the text again."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    v = Vocabulary(path)
    found = lexicon(frequent(stash(unit_counts(docs), "units"), size), v).collect()  # LEXICON rows at most
    known = {r.unit: [j for i in r.path for j in ([i] if i >= 0 else v.byte_ids(chr(-1 - i)))] for r in found}
    sent = spark.sparkContext.broadcast((path, known))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, base = sent.value
        known, flat, at = _start(path, base)
        for b, first, texts in _parts(batches):
            joined, starts, ends, hashes, counts = _units()(texts)
            distinct, place, back = np.unique(hashes, return_index=True, return_inverse=True)
            if known.full(len(distinct)):
                known, flat, at = _start(path, base)
            found = known.find(distinct)
            new = np.flatnonzero(found < 0)
            if len(new):
                said = [joined[i:j] for i, j in zip(starts[place[new]].tolist(), ends[place[new]].tolist(), strict=True)]
                for i in range(0, len(said), 20_000):
                    flat, at = _append(flat, at, encode_units(said[i : i + 20_000], path))
                found[new] = len(at) - 1 - len(new) + np.arange(len(new))
                known.add(distinct[new], found[new])
            ids, sizes = _gathered(flat, at, found[back])
            # Where each text's ids begin; a text of no units has none.
            limits = np.r_[0, np.cumsum(np.r_[0, np.cumsum(sizes)][np.cumsum(counts)] - np.r_[0, np.cumsum(sizes)][np.cumsum(counts) - counts])]
            same = _same(ids, limits, texts, path)
            rest = [b.column(i + 1).slice(first, len(texts)) for i in range(len(carry))]
            none = np.array([t is None for t in texts])
            lists = pa.ListArray.from_arrays(pa.array(limits.astype(np.int32), mask=np.r_[none, False]), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*rest, lists, pa.array(np.diff(limits), mask=none), pa.array(same, mask=none)], names=[*carry, "ids", "n_pieces", "round_trip"])

    rows = docs.select(F.col("text").cast("string").alias("_text"), *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(work, f"{kinds}, ids array<int>, n_pieces long, round_trip boolean")


def decode(encoded: DataFrame, path: str | None = None, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of carry and text, from ids."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [decode_ids(x.as_py(), path) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(texts, pa.string())], names=[*carry, "text"])

    rows = encoded.select("ids", *carry)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    return rows.mapInArrow(work, f"{kinds}, text string")
