"""Spelling variants of a corpus's words by anagram hashing.

Words are maximal runs of the letters A-Z, a-z and U+00C0-U+00FF of whole texts, A-Z in lower case. To have misspellings in them, one run of about every NOISE loses a letter: where NOISE divides
the CRC-32 of "<doc_id>:<run>", unsigned, the letter at that number modulo the run's length goes. Of the results those of LEAST code points or more that occur OFTEN times or more take part.

A word's anagram key is the sum of the fifth powers of its code points, modulo a prime. Two words that differ by one letter have keys that differ by that letter's power, if one has
a letter more, or by the difference of two letters' powers, if one letter is exchanged. So a word stands at its own key, and at that key less each of its letters' powers: a word with one letter more
meets the shorter one at the shorter one's key, and two words with a letter exchanged meet where either has lost its own. Anagrams meet there too. The order of letters, then, is verified in two steps:
words that differ by one letter have either the first half or the second half of the others in place, so that these letters go with the key, and what meets is held to an edit
distance of exactly 1, once for each pair.

A word's form is its near word with the greatest count (ties: the smallest in code-point order), if that is TIMES its own or more. Its root is where forms lead to in the end. As counts grow with
every form, there is no circle, and doubling the steps takes a few rounds.

Tasks count words for their own part of the texts first; the number of rows that are shuffled follows the vocabulary. No word has more near words than its length and the alphabet allow.

Nulls, empties, ties: a text that is null or has no such run has no words. A doc_id that is null counts as the empty string in the CRC. Rows that repeat count each. Columns other than doc_id and text
play no part, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_of, scratch, stash

NOISE = 199
LEAST, OFTEN, TIMES = 6, 5, 5
#: Shorter runs can't give a word: a letter is only ever taken away.
RUN = re.compile(f"[A-Za-zÀ-ÿ]{{{LEAST},}}")
LOWER = {i: i + 32 for i in range(ord("A"), ord("Z") + 1)}
#: A prime below 2**61: keys stay longs, whatever a word's length.
PRIME = (1 << 61) - 1
#: Distinct words that a task holds before it hands their counts on; rows of a batch, each of which may be a long text.
HELD, BATCH = 500_000, 1000


def noisy_words(doc_id: int | None, text: str | None) -> Iterator[str]:
    """The words of one text, shorter ones too where a letter of a run of LEAST went."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for run in RUN.findall((text or "").translate(LOWER)):
        h = zlib.crc32(run.encode(), start)
        if h % NOISE:
            yield run
        else:
            at = h % len(run)
            yield run[:at] + run[at + 1 :]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    for b in batches:
        for i, t in zip(b.column(0), b.column(1), strict=True):
            held.update(noisy_words(i.as_py(), t.as_py()))
            if len(held) > HELD:
                yield out()
                held.clear()
    yield out()


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): the words that take part."""
    texts = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).where("text IS NOT NULL")
    with batches_of(docs.sparkSession, BATCH):
        each = texts.mapInArrow(_counts, "word string, n bigint").where(f"char_length(word) >= {LEAST}")
        return stash(each.groupBy("word").agg(F.sum("n").alias("n")).where(f"n >= {OFTEN}"), "words")


def keyed(words: DataFrame) -> DataFrame:
    """(word, n, own, key, side, part): the keys that a word stands at, with the letters of either half that stay in place. own says that no letter has gone."""
    power = lambda c: f"aggregate(array(1, 2, 3, 4, 5), 1L, (p, i) -> p * ascii({c}) % {PRIME}L)"
    each = words.withColumn("letters", F.split("word", "")).withColumn("powers", F.expr(f"transform(letters, c -> {power('c')})"))
    each = each.withColumn("total", F.expr(f"aggregate(powers, 0L, (s, p) -> (s + p) % {PRIME}L)")).withColumn("long", F.char_length("word"))
    one_less = f"transform(array_distinct(powers), p -> struct((total - p + {PRIME}L) % {PRIME}L AS key, long - 1 AS left, false AS own))"
    each = each.select("word", "n", F.explode(F.expr(f"concat(array(struct(total AS key, long AS left, true AS own)), {one_less})")).alias("k"))
    # Of so many letters in common, half or more stand before or after the place that differs.
    halves = "array(struct(0 AS side, left(word, (k.left + 1) div 2) AS part), struct(1 AS side, right(word, (k.left + 1) div 2) AS part))"
    return each.select("word", "n", "k.own", "k.key", F.explode(F.expr(halves)).alias("h")).select("word", "n", "own", "key", "h.side", "h.part")


def differ_by_one(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point makes one of the other; in a time close to their length."""
    if len(a) > len(b):
        a, b = b, a
    low, high = 0, len(a)  # how much they have in common at their beginning
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    return a != b and (a[low + 1 :] == b[low + 1 :] if len(a) == len(b) else a[low:] == b[low + 1 :])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield b.filter(pa.array(map(differ_by_one, b["word"].to_pylist(), b["near"].to_pylist()), pa.bool_()))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): every pair of words at an edit distance of 1, both ways round."""
    keys = stash(keyed(words), "keys")
    a, b = keys.alias("a"), keys.alias("b")
    met = a.join(b, F.expr("a.key = b.key AND a.side = b.side AND a.part = b.part AND a.word < b.word AND NOT (a.own AND b.own)"))
    met = met.select("a.word", "a.n", F.col("b.word").alias("near"), F.col("b.n").alias("near_n")).distinct()
    met = stash(met.mapInArrow(_verified, "word string, n bigint, near string, near_n bigint"), "near")
    return met.unionAll(met.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the forms (word, form) of words lead to in the end."""
    at = stash(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "steps")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("top"))
        at = stash(at.join(on, "root", "left").select("word", F.coalesce("top", "root").alias("root"), F.col("top").isNotNull().alias("moved")), "steps")
        if at.where("moved").isEmpty():
            return at.select("word", "root")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root string, n, n_near, form_n long), a row for each word that takes part."""
    with scratch():
        words = word_counts(docs)
        near = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        formed = F.col("n") * TIMES <= -F.col("best.less")
        near = stash(near.select("word", "n_near", F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n")), "forms")
        ends = roots(near.where("form IS NOT NULL").select("word", "form"))
        out = words.join(near, "word", "left").join(ends, "word", "left")
        columns = ["word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), "form_n"]
        return stash(out.select(*columns), "variants", keep=True)


#: By words with a letter left open or out in DuckDB, whose own distance counts bytes; CRC-32 by its table, from its polynomial.
SQL = """
WITH RECURSIVE crc AS MATERIALIZED (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)
), runs AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents
  ) WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS (
  SELECT run, times, xor(list_reduce(bytes, lambda c, b: xor(c // 256, tab[CAST(xor(c % 256, b) + 1 AS BIGINT)]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM (SELECT run, times, list_transform(range(1, length(x) + 1, 2), lambda i: CAST(('0x' || x[i : i + 1]) AS BIGINT)) AS bytes
        FROM (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs)), crc
), words AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, times FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), cut AS MATERIALIZED (
  SELECT word, n, left(word, i - 1) || '*' || substr(word, i + 1) AS open, left(word, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.open = b.open AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.less = b.word UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.less = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, max(near_n) AS most, arg_min(near, (-near_n, encode(near))) AS first FROM near GROUP BY word, n
), forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.most >= 5 * w.n THEN b.first END AS form, CASE WHEN b.most >= 5 * w.n THEN b.most END AS form_n FROM words w LEFT JOIN best b USING (word)
), way AS (
  SELECT word, form AS at FROM forms WHERE form IS NOT NULL UNION ALL SELECT way.word, forms.form FROM way JOIN forms ON forms.word = way.at WHERE forms.form IS NOT NULL
), ends AS (
  SELECT way.word, way.at AS root FROM way JOIN forms ON forms.word = way.at WHERE forms.form IS NULL
)
SELECT f.word, f.form, coalesce(ends.root, f.word) AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n FROM forms f LEFT JOIN ends USING (word)
"""
