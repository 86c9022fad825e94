"""SimHash near-duplicates over an anchor covering.

Fingerprints of 64 bits link at 3 or fewer differing bits. Two such fingerprints differ in at most one bit in one
of their halves, so each half is covered on its own, with threshold 1. The anchors of a half are the words of the
[31, 26] Hamming code, a perfect code of covering radius 1: every 31-bit word has exactly one anchor, its home, within 1.
A fingerprint is replicated to every anchor within 1 + 1 = 2 of it (16 of them, or only its home if it is an anchor itself);
whatever links to x through this half has a replica at the home of x. Bit 31 of each half takes no part in the
anchors, only in the comparison of all 64 bits.

Groups of near copies can be large, so an anchor doesn't compare all pairs of its members. First its smallest home
member is compared with every replica, and the components of these links are formed; then only members of different
components still have to be compared, at anchors that hold more than one component. No link between two components is lost.

Nulls, empties, ties: a text that is null or has no word has fingerprint zero, and links like any other. Rows with the same
doc_id, or with none, each keep a row; component_id is the smallest doc_id that is not null in the component (null if it has none).
Columns other than doc_id and text play no part. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import FEW
from ..plans.tables import broadcast_if_small, shuffled
from .common import DOCUMENT_COLUMNS, components, document_columns, scratch, stash

MAX_BITS = 3
WORDS_PER_SHINGLE = 3
SEED = 42
#: Keys of rows that are sent to every task at most: the driver holds them too, at some 100 bytes each. No other side of a join is sent.
BROADCAST_ROWS = 300_000


def fingerprint(text: str | None) -> int:
    """Of one text, as an unsigned number; the shingles go through numpy in blocks, so memory doesn't follow the text's length."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = WORDS_PER_SHINGLE
    n = max(1, len(words) - k + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 65536):
        hashes = [xxh64_intdigest(b" ".join(words[j : j + k]), SEED) for j in range(i, min(n, i + 65536))]
        counts += np.unpackbits(np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fps = [fingerprint(x.as_py()) for x in b.column(1)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x - (1 << 64) if x >> 63 else x for x in fps], pa.int64())], names=["doc_id", "rid", "fp"])


def _half(h: int) -> Column:
    return F.expr(f"{'fp' if h == 0 else 'shiftrightunsigned(fp, 32)'} & 2147483647L")


def _syndrome(word: str) -> str:
    """Of the Hamming code whose positions are 1 to 31, position i being bit i - 1: the exclusive or of the positions set."""
    masks = [sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1) for k in range(5)]
    return " + ".join(f"(bit_count({word} & {m}L) % 2) * {1 << k}" for k, m in enumerate(masks))


def _anchored(fps: DataFrame) -> DataFrame:
    """With w0 and w1, the halves' words, and their syndromes s0 and s1."""
    out = fps.withColumns({"w0": _half(0), "w1": _half(1)})
    out = out.withColumns({f"s{h}": F.expr(f"CAST({_syndrome(f'w{h}')} AS INT)") for h in (0, 1)})
    return out


def _homes(fps: DataFrame) -> DataFrame:
    """(fp, key): the home anchors; a key has the half in bit 32."""
    key = [F.expr(f"(w{h} ^ IF(s{h} = 0, 0L, shiftleft(1L, s{h} - 1))) | {h << 32}L") for h in (0, 1)]
    return _anchored(fps).select("fp", F.explode(F.array(*key)).alias("key"))


def _replicas(fps: DataFrame) -> DataFrame:
    """A row for each anchor within 2 of the fingerprint's half."""

    def near(h: int) -> str:
        home = f"array((w{h} ^ IF(s{h} = 0, 0L, shiftleft(1L, s{h} - 1))) | {h << 32}L)"
        two = f"transform(filter(sequence(1, 31), i -> i < (i ^ s{h})), i -> (w{h} ^ shiftleft(1L, i - 1) ^ shiftleft(1L, (i ^ s{h}) - 1)) | {h << 32}L)"
        return f"IF(s{h} = 0, {home}, concat({home}, {two}))"

    return _anchored(fps).select("fp", F.explode(F.expr(f"concat({near(0)}, {near(1)})")).alias("key"))


def links(fps: DataFrame) -> DataFrame:
    """(node, root) for every fingerprint that links to another; fps: distinct values fp."""
    close = f"bit_count(fp ^ other) <= {MAX_BITS}"
    first = _homes(fps).groupBy("key").agg(F.min("fp").alias("other"), F.count("*").alias("homes"))
    met = stash(_replicas(fps).join(shuffled(first), "key").where("fp <> other OR homes > 1"), "met")
    star = met.where(f"fp <> other AND {close}").select(F.col("fp").alias("a"), F.col("other").alias("b"))
    joined = components(star, few=FEW)
    many = met.where("homes > 1").select("key", "fp").join(shuffled(joined.withColumnRenamed("node", "fp")), "fp", "left").select("key", "fp", F.coalesce("root", "fp").alias("root"))
    many = stash(many, "many")
    mixed = many.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    mixed = stash(many.join(shuffled(mixed), "key", "left_semi"), "mixed")
    at_home = mixed.join(shuffled(_homes(fps)), ["key", "fp"], "left_semi").select("key", F.col("fp").alias("other"), F.col("root").alias("other_root"))
    more = mixed.join(shuffled(at_home), "key").where(f"root <> other_root AND {close}").select(F.col("root").alias("a"), F.col("other_root").alias("b")).distinct()
    # Components of components: only roots are left to join.
    again = stash(components(more, few=FEW).select(F.col("node").alias("root"), F.col("root").alias("top")), "tops")
    return joined.select("node", "root").unionAll(again.select("root", "root")).distinct().join(shuffled(again), "root", "left").select("node", F.coalesce("top", "root").alias("root"))


def labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, fp, root, component_id): rid is a hash of doc_id and text, root the component's smallest fingerprint."""
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    marked = rows.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rid")).mapInArrow(_fingerprints, "doc_id bigint, rid bigint, fp bigint")
    marked = stash(marked, "fingerprints")
    with scratch():
        fps = stash(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
        roots = links(fps.select("fp")).withColumnRenamed("node", "fp")
        rooted = stash(fps.join(shuffled(roots), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        labels = stash(rooted.join(shuffled(least), "root").select("fp", "root", "component_id"), "labels", keep=True)
    return marked.join(shuffled(labels), "fp").select("doc_id", "rid", "fp", "root", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id long, fingerprint string, component_id long), a row for each row of docs."""
    return labelled(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, labelled: Callable[[DataFrame], DataFrame] = labelled) -> DataFrame:
    """The documents' five columns, one row of each component: that with the smallest doc_id. Rows without a doc_id come last; of
    rows with the same doc_id in one component one stays, always the same. labelled gives doc_id, rid and root.

    Only the few rows that are equal in doc_id and text are gathered with their texts; the others stay where they are, and the keys of those that go
    are sent to them if they are few."""
    docs = document_columns(docs)
    with scratch():
        marked = stash(labelled(docs), "labelled")
        best = marked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"))
        held = marked.groupBy("doc_id", "rid", "root").agg(F.count("*").alias("n")).join(shuffled(best), "root")
        stays = F.expr("rid = best.rid AND doc_id <=> best.doc_id")
        # A rid and doc_id may be in several components only if two texts share a hash: then the row stays.
        fate = held.groupBy("doc_id", "rid").agg(F.bool_or(stays).alias("stays"), F.sum("n").alias("n"))
        other = stash(fate.where("NOT stays OR n > 1").select(F.col("doc_id").alias("_doc"), F.col("rid").alias("_rid"), "stays"), "other", keep=True)
    rows = docs.withColumn("rid", F.xxhash64("doc_id", "text"))
    same = (F.col("rid") == F.col("_rid")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
    alone = rows.join(broadcast_if_small(other, BROADCAST_ROWS), same, "left_anti")
    twice = rows.join(broadcast_if_small(other.where("stays"), BROADCAST_ROWS), same, "left_semi")
    one = twice.groupBy("doc_id", "rid").agg(F.min(F.struct(*DOCUMENT_COLUMNS)).alias("d")).select("d.*")
    return alone.select(*DOCUMENT_COLUMNS).unionByName(one)
