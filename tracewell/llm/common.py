"""What the operators of this package share, besides the library's written tables and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import components
from ..plans.tables import scratch, shared_dir, stash, table

__all__ = ["DOCUMENT_COLUMNS", "batches_of", "components", "document_columns", "match_spans", "scratch", "shared_dir", "stash", "table"]

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
DOCUMENT_TYPES = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string", "n_chars": "bigint"}


def document_columns(docs: DataFrame) -> DataFrame:
    """The five columns of documents; a missing one is null, others are left out."""
    have = set(docs.columns)
    return docs.select(*[(F.col(c) if c in have else F.lit(None)).cast(DOCUMENT_TYPES[c]).alias(c) for c in DOCUMENT_COLUMNS])


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches have so many rows at most in what is written inside; the session's own number comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Characters before a match that go with it, and matches whose places are counted together.
BEFORE, TOGETHER = 80, 64
SPAN = "struct<start:int,end:int,value:string,before:string>"


def held(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is computed once."""
    return F.transform(F.array(value), use)[0]


def in_parts(items: Column, size: int) -> Column:
    """An array as an array of arrays of so many."""
    last = F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(items, k * size + 1, F.lit(size)))


def match_spans(text: Column, pattern: Column) -> Column:
    """Every match of pattern in text, leftmost and without overlap: an array of (start, end, value, before), in code points, end exclusive;
    before is what stands before it, back to the match before the last, BEFORE characters at most.

    Both are read once, whatever the number of matches: what lies between the matches gives their places. These are counted for TOGETHER matches at a
    time, as an array that grows by one is copied each time."""
    found, parts = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(parts, found, lambda p, v: F.struct(F.length(p).alias("skip"), F.right(p, F.lit(BEFORE)).alias("part"), v.alias("value")))
    none = F.array().cast(f"array<{SPAN}>")
    wide = lambda a, x: a + x["skip"] + F.coalesce(F.length(x["value"]), F.lit(0))

    def step(s: Column, x: Column) -> Column:
        begin = s["at"] + x["skip"]
        end = begin + F.length(x["value"])
        one = F.struct(begin.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(F.concat(s["last"], x["part"]), F.lit(BEFORE)).alias("before"))
        return F.when(x["value"].isNull(), s).otherwise(F.struct(end.alias("at"), x["value"].alias("last"), F.concat(s["out"], F.array(one)).alias("out")))

    def placed(chunks: Column) -> Column:
        sums = F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), wide))
        starts = F.aggregate(sums, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        last = lambda i: F.when(i == 0, F.lit("")).otherwise(F.element_at(chunks[i - 1], -1)["value"])
        spans = lambda c, at, i: F.aggregate(c, F.struct(at.alias("at"), last(i).alias("last"), none.alias("out")), step, lambda s: s["out"])
        return held(starts, lambda at: F.flatten(F.transform(chunks, lambda c, i: spans(c, at[i], i))))

    return held(pairs, lambda every: held(in_parts(every, TOGETHER), placed))
