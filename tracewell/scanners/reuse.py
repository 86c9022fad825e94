"""Existing functions for a new one or for a description: several channels of evidence, of which the strongest counts.

    python -m tracewell.scanners.reuse ROOT (--file PATH | --describe TEXT) [--index FILE] [--k N] [--min-score X]
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.sequences import seq_ratio
from ..operators import retrieval
from ..operators.retrieval import COVERAGE, JACCARD, Measure, asked, idf, records, vocabulary
from ..plans.tables import stash
from .capabilities import tag_tokens

#: The least similarity of bodies, the weights of the weaker channels, and the results by default.
BODY, LEXICAL, STRING, LEAST, K, BUDGET = 0.35, 0.8, 0.6, 0.3, 10, 5
LITERAL_WORD = "[a-z][a-z0-9_]{2,}"
#: Bodies compared for each result that is asked for before the least ratio is known.
TRIED = 4
#: Of elements: twice what is shared over both sizes, an upper bound of the ratio of matching blocks.
QUICK = Measure("2 * {w} / ({wq} + {wx})")


def literal_words(literals: Column | str) -> Column:
    """The distinct words of three letters or more in an array of texts, lower-cased."""
    return F.array_distinct(F.flatten(F.transform(literals, lambda x: F.regexp_extract_all(F.lower(x), F.lit(LITERAL_WORD), F.lit(0)))))


def index(symbols: DataFrame) -> DataFrame:
    """(key, name, reuse_tokens, calls, literals, tag): what is searched of each function; key is path:qualname, the first of its name by position."""
    first = symbols.withColumn("key", F.concat_ws(":", "path", "qualname")).groupBy("key").agg(F.min_by(F.struct("name", "reuse_tokens", "calls", "literals", tag_tokens("doc").alias("tag")), "position").alias("s"))
    return first.select("key", "s.*")


def _ends(table: DataFrame, column: str, key: str = "key") -> DataFrame:
    return table.select(F.col(key).alias("key"), F.explode(F.array_distinct(column)).alias("token"))


def _channel(queries: DataFrame, own: DataFrame, column: str, n: int | None, measure: Measure = JACCARD) -> tuple[DataFrame, DataFrame, Measure]:
    """What retrieval.strongest takes, for an array of tokens: weighted by rarity among n records, or evenly for None."""
    sets = stash(_ends(own, column), column)
    weights = idf(sets, n or 1)
    words = vocabulary(weights if n else weights.withColumn("idf", F.lit(1.0)))
    return asked(_ends(queries, column), words), records(sets, words), measure


def _ratios(pairs: DataFrame, queries: DataFrame, own: DataFrame) -> DataFrame:
    """(query, key, score) of the bodies' matching blocks; a pair whose lengths forbid a ratio of BODY is left out."""
    side = lambda df, name: df.select(F.col("key").alias(name), F.col("reuse_tokens").alias(f"{name}_tokens"))
    both = pairs.select("query", "key").join(side(queries, "query"), "query").join(side(own, "key"), "key")
    both = both.where(f"least(size(query_tokens), size(key_tokens)) >= {BODY}D * greatest(size(query_tokens), size(key_tokens))")
    return both.select("query", "key", seq_ratio("query_tokens", "key_tokens", BODY, below=True).alias("score"))


def _structural(queries: DataFrame, own: DataFrame, k: int) -> DataFrame:
    """(query, key, score) of bodies that can be among a query's k best by the ratio of their matching blocks, which is BODY or more.

    A body's elements are its tokens, each with the number of times that it has stood before; what two share of them bounds the ratio. The TRIED * k best by that bound are compared first; then
    only bodies whose bound reaches the k-th ratio."""
    elements = "flatten(transform(array_distinct(reuse_tokens), t -> transform(sequence(1, size(filter(reuse_tokens, x -> x = t))), i -> concat(i, ' ', t))))"
    elements = f"CASE WHEN size(reuse_tokens) > 0 THEN {elements} END"
    bodies = lambda df: stash(df.withColumn("elements", F.expr(elements)), "bodies")
    queries, own = bodies(queries), bodies(own)
    tokens, index, measure = _channel(queries, own, "elements", None, QUICK)

    compared = lambda pairs: stash(_ratios(pairs, queries, own), "ratios")
    first = compared(retrieval.top(tokens, index, measure, TRIED * k, other=True).where(f"score >= {BODY}"))
    order = W.partitionBy("query").orderBy(F.desc("score"))
    kth = first.where(f"score >= {BODY}").withColumn("n", F.row_number().over(order)).where(f"n = {k}").select("query", F.col("score").alias("kth"))
    floors = tokens.select("query").distinct().join(kth, "query", "left").select("query", F.greatest(F.lit(BODY), F.coalesce("kth", F.lit(0.0))).alias("floor"))
    rest = retrieval.at_least(tokens, index, measure, stash(floors, "floors"), other=True).select("query", "key")
    return first.unionByName(compared(rest.join(first, ["query", "key"], "left_anti"))).where("score > 0")


def for_symbols(queries: DataFrame, own: DataFrame, k: int = K, least: float = 0.0) -> DataFrame:
    """(query, rank, key, score, structural, call, string, lexical). queries and own: as index gives them; a function isn't found for itself."""
    n = own.count()
    bodies = stash(_structural(queries, own, k), "structural")
    channels = {"call": (*_channel(queries, own, "calls", n), 1.0), "string": (*_channel(queries, own, "literals", n), 1.0), "lexical": (*_channel(queries, own, "tag", None), LEXICAL)}
    found = [retrieval.top(*x[:3], k, other=True).select("query", "key") for x in channels.values()]
    pairs = bodies.select("query", "key")
    for f in found:
        pairs = pairs.unionByName(f)
    pairs = stash(pairs.distinct(), "pairs")
    whole = pairs.join(bodies.withColumnRenamed("score", "structural"), ["query", "key"], "left")
    for c, (tokens, sets, measure, _) in channels.items():
        whole = whole.join(retrieval.scored(pairs, tokens, sets, measure).withColumnRenamed("score", c), ["query", "key"], "left")
    names = ["structural", *channels]
    # A body that no search for bodies came upon has a ratio that can't count, but it is told.
    unseen = whole.where("structural IS NULL").select("query", "key")
    told = _ratios(unseen, queries, own).withColumnRenamed("score", "told")
    whole = whole.join(told, ["query", "key"], "left").withColumn("structural", F.coalesce("structural", "told")).drop("told").fillna(0.0, names)
    best = retrieval.merged(whole, {"structural": 1.0} | {c: x[3] for c, x in channels.items()}, k, least)
    return best.select("query", "rank", "key", F.round("score", 4).alias("score"), *[F.round(c, 4).alias(c) for c in names])


def for_symbols_with_closure(queries: DataFrame, own: DataFrame, k: int = K, least: float = 0.0) -> DataFrame:
    """for_symbols, where a query also gets what is found for the new functions that it calls by name, BUDGET of them in the order of names."""
    ranked = stash(for_symbols(queries, own, k), "ranked")
    named = queries.select(F.col("key").alias("callee"), F.col("name").alias("called"))
    calls = queries.select(F.col("key").alias("query"), F.explode("calls").alias("called")).join(named, "called").where("query <> callee")
    first = calls.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy("called", "callee"))).where(F.col("n") <= BUDGET)
    theirs = first.join(ranked.withColumnRenamed("query", "callee"), "callee").select(*ranked.columns)
    best = ranked.unionByName(theirs).groupBy("query", "key").agg(F.max_by(F.struct("score", "structural", "call", "string", "lexical"), "score").alias("s")).select("query", "key", "s.*").where(F.col("score") >= least)
    kept = best.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))).where(F.col("rank") <= k)
    return kept.select(*ranked.columns)


def for_descriptions(descriptions: DataFrame, own: DataFrame, k: int = K, least: float = 0.0) -> DataFrame:
    """(query, rank, key, score, name, lexical, string): the share of a description's weight that a function's name, tag line or literals have.
    descriptions: (key, text)."""
    said = stash(descriptions.select("key", F.explode(T.describe_tokens("text")).alias("token")), "described")
    n, channels = own.count(), {}
    for name, tokens, weight in (("name", T.name_tokens("name"), 1.0), ("lexical", F.col("tag"), LEXICAL), ("string", literal_words("literals"), STRING)):
        sets = stash(own.select("key", F.explode(F.array_distinct(tokens)).alias("token")), name)
        words = vocabulary(idf(sets, n))
        channels[name] = (asked(said, words), records(sets, words), COVERAGE, weight)
    best = retrieval.strongest(channels, k).where(F.col("score") >= least)
    return best.select("query", "rank", "key", F.round("score", 4).alias("score"), *[F.round(c, 4).alias(c) for c in channels])


def pairs(ranked: DataFrame) -> DataFrame:
    """(query, score, key), the best first."""
    return ranked.orderBy("query", "rank").select("query", "score", "key")


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracewell.scanners.reuse")
    p.add_argument("root")
    p.add_argument("--file", help="the functions of this file are the queries")
    p.add_argument("--describe", help="a description is the query")
    p.add_argument("--index", help="where the searched functions are written, a JSON line each")
    p.add_argument("--k", type=int, default=K)
    p.add_argument("--min-score", type=float, default=LEAST)
    said = p.parse_args(args)
    from ..session import session
    from ..sources import files, pysource

    spark = session()
    own = stash(index(pysource.symbols(files.scan(spark, said.root))), "index")
    if said.index:
        own.coalesce(1).write.mode("overwrite").json(said.index)
    if said.describe:
        found = for_descriptions(spark.createDataFrame([("description", said.describe)], "key string, text string"), own, said.k, said.min_score)
    elif said.file:
        mine = F.startswith(F.col("key"), F.lit(said.file + ":"))
        found = for_symbols_with_closure(own.where(mine), own.where(~mine), said.k, said.min_score)
    else:
        return 0
    # The best k of each query of one file.
    for r in found.orderBy("query", "rank").toJSON().toLocalIterator():
        print(json.dumps(json.loads(r), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
