"""Repeated substrings by content-defined chunks.

A gear rolling hash runs over the UTF-8 bytes of a text; the hash at a byte depends on that byte and the WINDOW - 1 before it. A chunk ends where the
hash has MASK_BITS zero bits, no sooner than MIN_BYTES after it began and no later than MAX_BYTES. So chunks follow the content, and an insertion
moves only the cuts near it. Chunks whose 128-bit digest stands in two documents or more repeat. Neighbouring
repeated chunks of a document form a run, and a run of LEAST_BYTES or more is a repeated passage. A passage of over 50 words that two
documents share loses the chunks at its two ends, and still holds such a run; a shared sentence doesn't. The first document of
each chunk, by doc_id, keeps it.

Chunks are found twice, instead of written: once to count half their digest, in the workers' rows before they are dealt out, and once to meet
the halves that two documents have. What stands often is one row per task in the count, and the join has both sides dealt by
the digest, so that a digest of many places can be split. The other half of the digest decides among what has met. No group is gathered.

Nulls, empties, ties: a null or empty text has no chunk. Rows that are equal in doc_id and text are one document. A null doc_id is a
document of its own by its text, and sorts last. Chunks at the very end of a text may be shorter than MIN_BYTES. A passage that repeats only inside one
document isn't reported. Columns other than doc_id and text play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

MASK_BITS = 4
MIN_BYTES, MAX_BYTES = 16, 96
LEAST_BYTES = 96
WINDOW = 16
#: One number for each byte, from a fixed generator.
GEAR = np.random.Generator(np.random.PCG64(20240229)).integers(0, 1 << 32, 256, dtype=np.uint32)


def hashes(data: bytes) -> np.ndarray:
    """The gear hash at every byte: h = 2 * h + GEAR[byte] in 32 bits, for all places at once by doubling the window."""
    h = GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < WINDOW:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def cuts(data: bytes) -> list[int]:
    """The ends of the chunks, in order; the last is the text's end."""
    if not data:
        return []
    wanted = np.flatnonzero(hashes(data) >> np.uint32(32 - MASK_BITS) == 0) + 1
    out, last, n = [], 0, len(data)
    ends = wanted.tolist()
    ends.append(n)
    for e in ends:
        while e - last > MAX_BYTES:
            last += MAX_BYTES
            out.append(last)
        if e - last >= MIN_BYTES or e == n and e > last:
            out.append(e)
            last = e
    return out


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each chunk. place: the start in bytes times 256, and the length, in one number."""
    from xxhash import xxh3_128_digest

    names = ["rid", "place", "d1", "d2"]
    for b in batches:
        rids, places, digests = [], [], bytearray()
        rest = len(b)
        for rid, x in zip(b.column(0), b.column(1), strict=True):
            data, start = (x.as_py() or "").encode("utf-8", "surrogatepass"), 0
            ends = cuts(data)
            for e in ends:
                digests += xxh3_128_digest(data[start:e])
                start = e
            ends = np.array(ends, np.int64)
            starts = np.r_[0, ends[:-1]] if len(ends) else ends
            places.append(starts * 256 + (ends - starts))
            rids.append(np.full(len(ends), rid.as_py(), np.int64))
            rest -= 1
            if len(digests) >= 1 << 21 or not rest:
                both = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
                columns = [np.concatenate(rids), np.concatenate(places), np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1])]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)
                rids, places, digests = [], [], bytearray()


def _rows(docs: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("rid", F.xxhash64("doc_id", "text"))


def chunks(docs: DataFrame) -> DataFrame:
    """(rid, place, d1, d2): the chunks of every text; place is the start in bytes times 256 and the length, rid a hash of doc_id and text."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return _rows(docs).select("rid", "text").mapInArrow(_chunked, "rid long, place long, d1 long, d2 long")


def repeats(docs: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """A row for each repeated passage of each document: doc_id, rid, start and end (bytes), n_places (those of its most
    frequent chunk), first_doc_id (the smallest that has its first chunk) and keep: whether every chunk of it stands here first."""
    halves = chunks(docs).groupBy("d1").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi")).where("lo < hi").select("d1")
    met = stash(chunks(docs).join(stash(halves, "halves"), "d1"), "met")
    ids = _rows(docs).groupBy("rid").agg(F.min("doc_id").alias("doc_id"))
    met = stash(met.join(stash(ids, "ids"), "rid"), "places")
    spread = met.groupBy("d1", "d2").agg(F.min("rid").alias("lo"), F.max("rid").alias("hi"), F.count("*").alias("n"), F.min("doc_id").alias("first_doc_id"))
    spread = stash(spread.where("lo < hi").select("d1", "d2", "n", "lo", "first_doc_id"), "repeated")
    both = met.join(spread, ["d1", "d2"]).select(
        "doc_id",
        "rid",
        F.expr("shiftright(place, 8)").alias("start"),
        F.expr("shiftright(place, 8) + (place & 255L)").alias("end"),
        "n",
        "first_doc_id",
        F.expr("doc_id <=> first_doc_id AND (doc_id IS NOT NULL OR rid = lo)").alias("here"),
    )
    own = W.partitionBy("rid").orderBy("start")
    both = both.withColumn("new", F.expr("IF(start <= lag(end) OVER (PARTITION BY rid ORDER BY start), 0, 1)"))
    runs = both.withColumn("run", F.sum("new").over(own)).groupBy("doc_id", "rid", "run").agg(
        F.min("start").alias("start"),
        F.max("end").alias("end"),
        F.max("n").alias("n_places"),
        F.min_by("first_doc_id", "start").alias("first_doc_id"),
        F.min("here").alias("keep"),
    )
    return runs.where(F.col("end") - F.col("start") >= least).drop("run")


def dedup(docs: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """(doc_id, text, n_cut): the texts without the repeated passages that another document keeps. A cut that would fall inside a
    character moves to the character's end."""
    gone = repeats(docs, least).where("NOT keep").groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("gone"))
    both = _rows(docs).join(stash(gone, "gone"), "rid", "left").select("doc_id", "text", "gone")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, counts = [], []
            for t, g in zip(b.column(1), b.column(2), strict=True):
                t, g = t.as_py(), g.as_py() or []
                if g:
                    data, at, kept = t.encode("utf-8", "surrogatepass"), 0, []
                    inside = lambda i: i < len(data) and data[i] & 0xC0 == 0x80  # noqa: E731, B023
                    for span in g:
                        start, end = span["start"], span["end"]
                        while inside(start):
                            start += 1
                        while inside(end):
                            end += 1
                        kept.append(data[at:start])
                        at = max(at, end)
                    t = b"".join([*kept, data[at:]]).decode("utf-8", "surrogatepass")
                texts.append(t)
                counts.append(len(g))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64())], names=["doc_id", "text", "n_cut"])

    return both.mapInArrow(cut, "doc_id long, text string, n_cut long")
