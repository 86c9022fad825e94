"""Ranked retrieval over token sets weighted by inverse document frequency."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import broadcast_if_small, parallelism, stash

#: Postings that the first round of a search takes for each result that is asked for, and how many times more each next round does.
FIRST, GROWTH = 16, 8
#: Rows of queries, or of tokens' weights, that are sent to every task at most.
BROADCAST_QUERIES = 200_000
#: Pairs (query, key) that are sent to the records at most; beyond, both are shuffled.
BROADCAST_PAIRS = 1_000_000


def token_sets(records: DataFrame, key: str, tokens) -> DataFrame:
    """(key, token), distinct."""
    return records.select(F.col(key).alias("key"), F.explode(F.array_distinct(tokens)).alias("token"))


def idf(sets: DataFrame, n: int) -> DataFrame:
    """(token, df, idf): ln((n + 1) / (df + 1)) + 1 over n records."""
    counted = sets.groupBy("token").agg(F.count("*").alias("df"))
    return counted.withColumn("idf", F.log((F.lit(n) + 1.0) / (F.col("df") + 1.0)) + 1.0)


def vocabulary(weights: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    """weights (token, df, idf) with an id for each token, a written table: searches compare these. What asked and records are given has to be one vocabulary. queries (key, token): only their tokens get
    in, which is all that their search compares; then records has to be told what records weigh."""
    if queries is not None:
        tokens = stash(queries.select("token").distinct(), "asked tokens")
        weights = weights.join(broadcast_if_small(tokens, BROADCAST_QUERIES), "token", "left_semi")
    return stash(weights.select("token", "df", "idf").withColumn("id", F.monotonically_increasing_id()), "vocabulary")


def records(sets: DataFrame, words: DataFrame, wx: str | DataFrame | None = None) -> DataFrame:
    """(key, tokens, wx), a written table: the ids of each record's distinct tokens and their weight, for searches. sets: (key, token), words: as vocabulary gives them, with every token of sets.

    With wx, words may be the tokens of the queries alone, and records without one of these are left out. wx is (token, df, idf) of every token, which the records' weight is summed up from; or "even", where each of
    a record's tokens weighs 1; or "shared", for measures that don't ask what a record weighs: then it is the weight of its tokens in words."""
    if wx is None or isinstance(wx, str) and wx == "shared":
        weighed = sets.join(broadcast_if_small(words.select("token", "idf", "id"), BROADCAST_QUERIES), "token")
    elif isinstance(wx, str):
        weighed = sets.join(broadcast_if_small(words.select("token", "id"), BROADCAST_QUERIES), "token", "left").withColumn("idf", F.lit(1.0))
    else:
        weighed = _weighed(sets, wx, words)
    held = weighed.groupBy("key").agg(F.collect_list("id").alias("tokens"), F.sum("idf").alias("wx"))
    return stash(held if wx is None else held.where("size(tokens) > 0"), "records")


def _weighed(sets: DataFrame, wx: DataFrame, words: DataFrame) -> DataFrame:
    """sets with each token's idf, and its id if words has it. The weights of the BROADCAST_QUERIES most frequent tokens, about, are sent to every task, and only the others' places are shuffled: few of all, so
    a record's tokens are mostly summed up where it stands."""
    every, n = wx.select("token", "df", "idf").join(broadcast_if_small(words.select("token", "id"), BROADCAST_QUERIES), "token", "left"), wx.count()
    if n <= BROADCAST_QUERIES:
        return sets.join(F.broadcast(every.drop("df")), "token")
    least = wx.agg(F.percentile_approx("df", 1 - BROADCAST_QUERIES / n)).first()[0]
    common, rare = (every.where(F.col("df") > least).drop("df"), every.where(F.col("df") <= least).drop("df"))
    return sets.join(F.broadcast(common), "token").unionByName(sets.join(F.broadcast(common.select("token")), "token", "left_anti").join(rare, "token"))


class Measure(NamedTuple):
    """A score of the weight w that a query of weight wq shares with a record of weight wx, as SQL: it must not fall as w grows."""

    score: str


JACCARD, COVERAGE = Measure("{w} / ({wq} + {wx} - {w})"), Measure("{w} / {wq}")
#: Scores are ranked to six decimals, so a bound has to fail by more.
NEAR = 1e-6


def asked(queries: DataFrame, words: DataFrame) -> DataFrame:
    """(query, token, idf, reach, rest, wq), a written table: a query's tokens by id, rarest first. reach: how many postings this token and those before it have; rest: what this one and those after it
    weigh; wq: the whole query's weight. A token that isn't in words (a vocabulary) weighs 1, and is left out, as no record has it. queries: (key, token), distinct."""
    own = queries.select(F.col("key").alias("query"), "token").join(words, "token", "left")
    order = W.partitionBy("query").orderBy(F.coalesce("df", F.lit(0)), "token")
    all_of = W.partitionBy("query")
    own = own.withColumn("wq", F.sum(F.coalesce("idf", F.lit(1.0))).over(all_of)).withColumn("known", F.sum(F.when(F.col("df").isNotNull(), F.col("idf"))).over(all_of))
    own = own.withColumn("reach", F.sum("df").over(order)).withColumn("rest", F.col("known") - F.sum("idf").over(order) + F.col("idf")).where("df IS NOT NULL")
    return stash(own.select("query", F.col("id").alias("token"), "idf", "reach", "rest", "wq"), "asked")


def _small(tokens: DataFrame) -> tuple[int, bool]:
    """The most postings that a query's tokens have, and whether the queries are few enough to be sent to every task."""
    most, n = tokens.agg(F.max("reach"), F.count("*")).first()
    return most or 0, n <= BROADCAST_QUERIES


def scored(pairs: DataFrame, tokens: DataFrame, index: DataFrame, measure: Measure, small: bool = False) -> DataFrame:
    """(query, key, score) of the pairs (query, key), computed from whole records; to six decimals. small: whether the queries are sent to every task."""
    pairs_of = F.sort_array(F.collect_list(F.struct("token", "idf")))
    weight = tokens.groupBy("query").agg(pairs_of.alias("q"), F.first("wq").alias("wq")).select("query", "wq", F.col("q.token").alias("ids"), F.col("q.idf").alias("idfs"))
    pairs = stash(pairs.select("query", "key"), "pairs")
    if pairs.count() <= BROADCAST_PAIRS:
        both = index.join(F.broadcast(pairs), "key")
    else:
        # Few rows of much work: dealt out by number, or they would come together in a task or two.
        both = pairs.repartition(parallelism(pairs), "key").join(index, "key")
    both = both.join(F.broadcast(weight) if small else weight, "query")
    shared = "aggregate(array_sort(array_intersect(tokens, ids)), 0.0D, (s, t) -> s + element_at(idfs, CAST(array_position(ids, t) AS INT)))"
    both = both.withColumn("w", F.expr(shared))
    return both.select("query", "key", F.round(F.expr(measure.score.format(w="w", wq="wq", wx="wx")), 6).alias("score"))


def _candidates(tokens: DataFrame, index: DataFrame, floors: DataFrame | None, measure: Measure, other: bool, small: bool) -> DataFrame:
    """(query, key): records that share some of the tokens and could reach the query's floor. floors: (query, floor); a query without one has none.

    A record comes in by a token only if sharing all that are left of the query from it on would do. The tokens that a pair was joined by are its first ones; so what they weigh, with all that is left after
    the last of them, bounds what it shares, and that has to do as well."""
    sent = F.broadcast if small else lambda x: x
    asks = tokens.withColumn("floor", F.lit(0.0)) if floors is None else tokens.join(sent(floors), "query", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0)))
    asks = asks.where(f"rest / wq >= floor - {NEAR}").select("query", "token", "idf", "rest", "wq", "floor")
    postings = index.select("key", "wx", F.explode("tokens").alias("token"))
    could = lambda w: measure.score.format(w=f"least({w}, wx)", wq="wq", wx="wx")
    met = postings.join(sent(asks), "token").where(f"{could('rest')} >= floor - {NEAR}")
    met = (met.where("query <> key") if other else met).groupBy("query", "key").agg(F.sum("idf").alias("w"), F.min(F.expr("rest - idf")).alias("left"), *[F.first(c).alias(c) for c in ("wq", "floor", "wx")])
    return met.where(f"{could('w + left')} >= floor - {NEAR}").select("query", "key")


def top(tokens: DataFrame, index: DataFrame, measure: Measure, k: int, other: bool = False) -> DataFrame:
    """(query, rank, key, score): each query's k best records with a score over zero, ties to the smaller key. tokens as asked gives them, index as records does.

    Rarest tokens first, in rounds: a round takes as many of each query's tokens as have GROWTH times the postings of the last. What a record could still score that has none of the tokens taken is
    bounded by the weight of the others, and by its own weight; once that is below the k-th score found, the query is over. So common tokens are hardly ever joined. With other, a record
    with the query's own key isn't found."""
    last, small = _small(tokens)
    order = W.partitionBy("query").orderBy(F.desc("score"), "key")
    best = seen = floors = None
    low, high = 0, FIRST * k
    while low < last:
        made = _candidates(tokens.where((F.col("reach") > low) & (F.col("reach") <= high)), index, floors, measure, other, small)
        new = stash(scored(made if seen is None else made.join(seen, ["query", "key"], "left_anti"), tokens, index, measure, small), "scored")
        every = new if best is None else best.drop("rank").unionByName(new)
        best = stash(every.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        floors = best.where(F.col("rank") == k).select("query", F.col("score").alias("floor"))
        seen = new.select("query", "key") if seen is None else seen.unionByName(new.select("query", "key"))
        low, high = high, high * GROWTH
        if low < last:
            # The next rounds' tokens that a record could still come in by.
            left = tokens.where(F.col("reach") > low).join(F.broadcast(floors) if small else floors, "query", "left").where(f"rest / wq >= coalesce(floor, 0) - {NEAR}")
            least = left.agg(F.min("reach")).first()[0]
            low, high = (last, last) if least is None else (low, max(high, least))
    if best is None:
        return tokens.select("query", F.lit(0).alias("rank")).join(index.select("key"), F.lit(False)).select("query", "rank", "key", F.lit(0.0).alias("score"))
    return best.select("query", "rank", "key", "score")


def at_least(tokens: DataFrame, index: DataFrame, measure: Measure, floors: DataFrame, other: bool = False) -> DataFrame:
    """(query, key, score): every record whose score is its query's floor or more. floors: (query, floor), over zero."""
    small = _small(tokens)[1]
    found = scored(_candidates(tokens.join(floors.select("query"), "query", "left_semi"), index, floors, measure, other, small), tokens, index, measure, small)
    return found.join(F.broadcast(floors) if small else floors, "query").where("score >= floor").select("query", "key", "score")


def weighted_jaccard(queries: DataFrame, index: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, key, score): shared weight over the weight of either. queries and index: (key, token)."""
    words = vocabulary(weights, queries)
    return top(asked(queries, words), records(index, words, weights), JACCARD, k)


def coverage(queries: DataFrame, index: DataFrame, weights: DataFrame, k: int = 10) -> DataFrame:
    """(query, rank, key, score): the share of the query's weight that a record has."""
    words = vocabulary(weights, queries)
    return top(asked(queries, words), records(index, words, "shared"), COVERAGE, k)


def strongest(channels: dict[str, tuple[DataFrame, DataFrame, Measure, float]], k: int, other: bool = False) -> DataFrame:
    """(query, rank, key, score, and a column for each channel): the k best of each query by the greatest of its channels' scores times their weights.
    channels: name to (tokens, index, measure, weight). A record among the k best is among the k best of the channel that it owes its score to, so each channel is searched for k; what
    is found is then scored in every channel."""
    found = {c: top(tokens, index, measure, k, other) for c, (tokens, index, measure, _) in channels.items()}
    pairs = stash(reduce(DataFrame.unionByName, (f.select("query", "key") for f in found.values())).distinct(), "pairs")
    for c, (tokens, index, measure, _) in channels.items():
        one = scored(pairs.select("query", "key"), tokens, index, measure, _small(tokens)[1]).withColumnRenamed("score", c)
        pairs = pairs.join(one, ["query", "key"], "left")
    return merged(pairs.fillna(0.0, list(channels)), {c: x[3] for c, x in channels.items()}, k)


def merged(pairs: DataFrame, weights: dict[str, float], k: int, least: float = 0.0) -> DataFrame:
    """Of (query, key, a score for each channel) the k best of each query by the greatest score times its weight, with that as score."""
    best = pairs.withColumn("score", F.round(F.greatest(F.lit(0.0), *[F.col(c) * w for c, w in weights.items()]), 6)).where((F.col("score") > 0) & (F.col("score") >= least))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "key"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "key", "score", *weights)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    scored = scored.withColumn("score", F.round("score", 6)).where("score > 0")
    order = W.partitionBy("query").orderBy(F.desc("score"), "key")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "key", "score")


def closure(ranked: DataFrame, calls: DataFrame, k: int = 10, budget: int = 5) -> DataFrame:
    """One hop: a query also gets what the queries that it calls got, the first budget of them by name; the highest score for each key.
    calls: (query, callee)."""
    first = calls.where("query <> callee").distinct().withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy("callee"))).where(F.col("_n") <= budget)
    theirs = first.join(ranked.select(F.col("query").alias("callee"), "key", "score"), "callee").select("query", "key", "score")
    best = ranked.select("query", "key", "score").unionByName(theirs).groupBy("query", "key").agg(F.max("score").alias("score"))
    return _ranked(best, k)


def recall_and_mrr(ranked: DataFrame, truth: DataFrame, cuts: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: n, recall_at_<cut> for each, and mrr. truth: (query, key), one key for each query."""
    met = truth.join(ranked.select("query", "key", "rank"), ["query", "key"], "left")
    shares = [F.round(F.avg(F.when(F.col("rank") <= c, 1.0).otherwise(0.0)), 6).alias(f"recall_at_{c}") for c in cuts]
    return met.agg(F.count("*").alias("n"), *shares, F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))
