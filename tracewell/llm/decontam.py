"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Texts are read as words: runs of letters and digits of the lower-cased text. A seed is a fixed mask over SPAN words
in a row; it hashes the words where the mask has a 1 and ignores the others, so substitutions there don't hide an overlap. The seeds
at every position of every document meet the seeds of the benchmark's items; each hit gives a diagonal (the document's position less the item's).
On that diagonal the item is held against the document word by word, and the overlap counts if some WINDOW words in a row (the
whole item, if shorter) have SIMILARITY of their words equal.

With every=True the masks are COVER, and SHORT for items of MIN_WORDS to SPAN - 1 words, and no overlap that counts is missed. SIMILARITY
allows two other words in a window of 10 to 13; some 10 words in a row of it have at most two, and wherever two of 10 stand, a mask of
COVER fits beside them. It allows one other word in an item of 5 to 9; some 5 words in a row have at most one, and a mask of SHORT fits.
With every=False the masks are MASKS, short items are sought as they are, without ignored positions, and overlaps can be missed.

The benchmark's seeds are broadcast while there are BROADCAST_SEEDS or fewer; beyond, the join shuffles. Equal items are sought once.

Nulls, empties, ties: null texts and texts of fewer than MIN_WORDS words overlap nothing, on either side: so few words are no evidence. Items
without an id come out with a null item_id. Rows of documents that are equal in doc_id and text come out once. Ties between
diagonals go to the smallest. Columns other than the ids and texts play no part. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, stash

MASKS = ("1101101011", "1110010111")
#: Of weight 6; found by search, tested by counting.
COVER = ("1110111", "11011011", "1110000111", "111111", "1101001011")
SHORT = ("1111", "10111", "11011", "11101")
SPAN = 10
MIN_WORDS = 5
WINDOW = 13
SIMILARITY = 0.8
#: Positions that are hashed at a time, so that a long text never stands as one table of shifted copies.
BLOCK = 4096
BROADCAST_SEEDS = 300_000
BROADCAST_ROWS = 300_000
_WORDS = "split(trim(regexp_replace(lower(text), '[^\\\\p{L}\\\\p{N}]+', ' ')), ' ')"


def _worded(df: DataFrame) -> DataFrame:
    """With words, those of text; without rows that have too few."""
    return df.withColumn("words", F.expr(_WORDS)).where(f"size(words) >= {MIN_WORDS}")


def _seeds(df: DataFrame, masks: list[str]) -> DataFrame:
    """(key, pos, seed) of every position; df: (key, words). The seed of a mask beyond the end is null, and left out."""
    width = SPAN - 1
    blocks = f"transform(sequence(0, (size(h) - 1) div {BLOCK}), b -> slice(h, b * {BLOCK} + 1, {BLOCK + width}))"
    shifted = df.select("key", F.expr("transform(words, w -> xxhash64(w))").alias("h")).select("key", F.posexplode(F.expr(blocks)).alias("block", "h"))
    # The array that starts at each offset; arrays_zip fills the shorter ones with nulls.
    columns = ", ".join([f"slice(h, {i + 1}, greatest(0, least({BLOCK}, size(h) - {i})))" for i in range(SPAN)])
    at = shifted.select("key", "block", F.posexplode(F.expr(f"arrays_zip({columns})")).alias("i", "z"))
    at = at.select("key", F.expr(f"block * {BLOCK} + i").alias("pos"), *[F.col("z").getField(str(i)).alias(f"h{i}") for i in range(SPAN)])

    def seed(mask: str) -> str:
        used = [f"h{i}" for i, x in enumerate(mask) if x == "1"]
        return f"IF({used[-1]} IS NULL, NULL, xxhash64({len(mask)}, '{mask}', {', '.join(used)}))"

    every = [seed(m) for m in masks]
    return at.select("key", "pos", F.explode(F.expr(f"array({', '.join(every)})")).alias("seed")).where("seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame, every: bool = False) -> DataFrame:
    """(doc_id, rid, item_id, start, n_equal, n_words, best): a row for each document and item that overlap. start: the word of the
    document where the item's first word would stand; n_equal: the item's words that stand there; best: the most within a window.
    rid is xxhash64(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("rid", F.xxhash64("doc_id", "text"))
    items = _worded(benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text"))).select("item_id", "words")
    items = stash(items.withColumn("key", F.xxhash64("words")), "items")
    texts = stash(items.groupBy("key").agg(F.first("words").alias("words")), "texts")
    lengths = sorted(r[0] for r in texts.select(F.size("words").alias("n")).where(f"n < {SPAN}").distinct().collect())  # at most SPAN - MIN_WORDS of them
    masks, short_masks = (COVER, SHORT if lengths else ()) if every else (MASKS, ["1" * n for n in lengths])
    sought = _seeds(texts.where(f"size(words) >= {SPAN}"), [*masks])
    if every and lengths:
        sought = sought.unionAll(_seeds(texts.where(f"size(words) < {SPAN}"), [*SHORT]))
    short = [] if every else [
        texts.where(f"size(words) = {n}").select("key", F.lit(0).alias("pos"), F.expr(f"xxhash64({n}, '{'1' * n}', {', '.join(f'xxhash64(words[{i}])' for i in range(n))})").alias("seed"))
        for n in lengths
    ]
    for s in short:
        sought = sought.unionAll(s)
    sought = stash(sought.select(F.col("key").alias("item"), F.col("pos").alias("item_pos"), "seed").distinct(), "seeds")
    few = sought.count() <= BROADCAST_SEEDS
    found = _seeds(_worded(docs).select(F.col("rid").alias("key"), "words"), [*masks, *short_masks]).join(F.broadcast(sought) if few else sought, "seed")
    hits = stash(found.select(F.col("key").alias("rid"), "item", F.expr("pos - item_pos").alias("diagonal")).distinct(), "hits")
    rids = stash(hits.select("rid").distinct(), "rids")
    few = rids.count() <= BROADCAST_ROWS
    hit_docs = _worded(docs.join(F.broadcast(rids) if few else rids, "rid", "left_semi")).dropDuplicates(["rid"]).select("doc_id", "rid", "words")
    both = hits.join(stash(hit_docs, "documents"), "rid").join(texts.select(F.col("key").alias("item"), F.col("words").alias("item_words")), "item")
    both = both.withColumn("equal", F.expr("transform(item_words, (w, j) -> IF(coalesce(get(words, diagonal + j) = w, false), 1, 0))"))
    both = both.withColumn("width", F.expr(f"least({WINDOW}, size(equal))"))
    both = both.withColumn("best", F.expr("array_max(transform(sequence(0, size(equal) - width), s -> aggregate(slice(equal, s + 1, width), 0, (a, x) -> a + x)))"))
    both = both.where(f"best >= width * {SIMILARITY}D").select("doc_id", "rid", "item", "diagonal", F.expr("aggregate(equal, 0, (a, x) -> a + x)").alias("n_equal"), F.size("item_words").alias("n_words"), "best")
    one = both.groupBy("doc_id", "rid", "item").agg(F.max(F.struct("best", "n_equal", (-F.col("diagonal")).alias("back"), "n_words")).alias("m"))
    one = stash(one, "found").join(items.select(F.col("key").alias("item"), "item_id"), "item")
    long = {x: F.col(f"m.{x}").cast("bigint").alias(x) for x in ("n_equal", "n_words", "best")}
    return one.select("doc_id", "rid", "item_id", (-F.col("m.back")).cast("bigint").alias("start"), *long.values())


def contaminated(docs: DataFrame, benchmark: DataFrame, every: bool = False) -> DataFrame:
    """(doc_id, item_id, start, n_equal, n_words, best) of every document and item that overlap."""
    return overlaps(docs, benchmark, every).drop("rid")


def clean(docs: DataFrame, benchmark: DataFrame, every: bool = False) -> DataFrame:
    """The rows of docs that overlap no item."""
    with scratch():
        rids = stash(overlaps(docs, benchmark, every).select("rid").distinct(), "contaminated", keep=True)
    few = rids.count() <= BROADCAST_ROWS
    rows = docs.select("*", F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("__rid"))
    rids = rids.withColumnRenamed("rid", "__rid")
    return rows.join(F.broadcast(rids) if few else rids, "__rid", "left_anti").drop("__rid")
