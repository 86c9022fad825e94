"""Exact top-k by inner product with a table of distances to pivots.

Vectors are held as integers: floor(SCALE * x) of every component. For vectors q and x, q . x = (|q|^2 + |x|^2 - d(q, x)^2) / 2, and for every pivot p
d(q, x) >= |d(q, p) - d(x, p)|. So the largest of these lower bounds over PIVOTS pivots bounds the score from above. A task holds a block
of candidates with their distances to the pivots, takes one block of queries after the other, orders the candidates of a query by
their bounds and evaluates them in that order, until no bound reaches the k-th score found so far. Bounds are taken in floating point with a
margin for rounding; scores are integers, exact. A block gives each query's k best; the best of those over all blocks are the result.

Candidates are dealt into blocks of about BLOCK rows by a hash, queries into blocks of about QUERIES rows; each pair of blocks is one group, so a
task's memory is bounded, whatever the tables' size, and no side is broadcast. The pivots are the vectors of smallest hash, PIVOTS of them.

Vectors with components so large that scores might not fit into a long (see LARGEST) are scored by Python's integers, each of them with every other vector. Scores
beyond a long are ranked as they are and told as the nearest long.

Nulls, empties, ties: vectors that are null, empty or hold a null or a component that isn't finite take no part, nor do rows without an id. Vectors of
different length never meet. Ties go to the smaller id. Rows that repeat an id count once for a pair of ids, with the highest score.
Columns other than the id and the vector play no part. Empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

SCALE = 256
PIVOTS = 32
BLOCK, QUERIES = 16384, 2048
#: Candidates of a query that are evaluated at a time: bounds order them, and the test for stopping comes between.
STEP = 64
#: Where a component times the root of their number reaches this, scores may not fit into a long.
LARGEST = 1 << 23
#: Hexadecimal digits of a score of any finite doubles.
DIGITS = 600


def integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def _usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v array<long>, raw array<double>): one of v and raw is null, v where LARGEST is reached."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    small = F.forall(vector, lambda x: F.abs(x.cast("double")) * F.sqrt(F.size(vector)) < LARGEST)
    rows = df.where(F.col(key).isNotNull() & (F.size(vector) > 0)).where(finite)
    return rows.select(F.col(key).cast("bigint").alias("id"), F.when(small, integers(F.col(vector))).alias("v"), F.when(~small, F.col(vector).cast("array<double>")).alias("raw"))


def _exact(vector: list | None, raw: list | None) -> list[int]:
    """The integers of a vector of either form."""
    return [math.floor(x * SCALE) if abs(x) < 2.0**52 else int(x) * SCALE for x in raw] if vector is None else vector


def _told(score: int) -> tuple[int, str]:
    """A score as the nearest long, and what orders those that are beyond one."""
    told = max(-(1 << 63), min((1 << 63) - 1, score))
    return told, "" if told == score else format(score if score > 0 else (1 << 4 * DIGITS - 1) + score, "x").zfill(DIGITS)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def search_block(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, pivots: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    """For each query: its id, the ids and scores of its k best in the block (ties to the smaller id), and how many were evaluated."""
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**52  # then products in doubles are exact
    xs, qs = x.astype(np.float64), q.astype(np.float64)
    ps = pivots.astype(np.float64)
    squares = (xs * xs).sum(axis=1)

    def distances(a: np.ndarray) -> np.ndarray:
        d = (a * a).sum(axis=1)[:, None] + (ps * ps).sum(axis=1)[None] - 2 * a @ ps.T
        return np.sqrt(np.maximum(d, 0)).T

    table, own = np.ascontiguousarray(distances(xs)), distances(qs)
    # Rounding of a square of size s is far below s / 2**40; its root errs most where the distance is near zero.
    size = max(1.0, float(squares.max(initial=0)), float((qs * qs).sum(axis=1).max(initial=0)), float((ps * ps).sum(axis=1).max(initial=0)))
    slack = 2 * np.sqrt(size) * 2.0**-20
    for i in range(len(q)):
        low = np.abs(table[0] - own[0, i]) if len(ps) else np.zeros(len(ids))
        for j in range(1, len(ps)):
            np.maximum(low, np.abs(table[j] - own[j, i]), out=low)
        bound = (squares + float(qs[i] @ qs[i]) - np.maximum(low - slack, 0) ** 2) / 2 + size * 2.0**-40 + 0.5
        found_ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        least, done, step = -np.inf, 0, STEP
        left = np.flatnonzero(ids != q_ids[i])
        while len(left):
            take = min(step, len(left))
            part = np.argpartition(-bound[left], take - 1) if take < len(left) else np.arange(len(left))
            now, rest = left[part[:take]], left[part[take:]]
            now = now[bound[now] >= least]
            if not len(now):
                break
            done += len(now)
            score = (xs[now] @ qs[i]).astype(np.int64) if exact else x[now] @ q[i]
            found_ids, found = np.concatenate([found_ids, ids[now]]), np.concatenate([found, score])
            best = np.lexsort((found_ids, -found))
            found_ids, found = found_ids[best], found[best]
            first = np.sort(np.unique(found_ids, return_index=True)[1])[:k]  # an id once
            found_ids, found = found_ids[first], found[first]
            if len(found) == k:
                least = found[-1]
            left, step = rest[bound[rest] >= least], step * 4
        yield int(q_ids[i]), found_ids, found, done


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id long, rank int, vec_id long, score long): each query's k best among the vectors with another id. queries: rows like those of vectors."""
    every, asked = stash(_usable(vectors, key, vector), "vectors"), stash(_usable(queries, key, vector), "queries")
    xs, qs = every.where("v IS NOT NULL"), asked.where("v IS NOT NULL")
    n, m = xs.count(), qs.count()
    parts, rounds = max(1, -(-n // BLOCK)), max(1, -(-m // QUERIES))
    pivots = xs.orderBy(F.xxhash64("v"), "id").limit(PIVOTS).select("v").collect()
    by_width: dict[int, list] = {}
    for r in pivots:
        by_width.setdefault(len(r.v), []).append(r.v)
    sent = xs.sparkSession.sparkContext.broadcast(by_width)
    part = F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")
    turn = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rounds)).cast("int")
    # Each block of candidates goes once to each block of queries, and the other way round.
    left = xs.select("id", "v", F.size("v").alias("width"), part.alias("part"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("turn"))
    right = qs.select("id", "v", F.size("v").alias("width"), turn.alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def search(_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if len(a) and len(b):
            width = a["width"][0].as_py()
            ids, x = np.asarray(a["id"]), _matrix(a["v"].combine_chunks(), width)
            q_ids, q = np.asarray(b["id"]), _matrix(b["v"].combine_chunks(), width)
            p = np.array(sent.value.get(width, np.zeros((0, width))), np.int64).reshape(-1, width)
            for query, found, scores, _n in search_block(q_ids, q, ids, x, p, k):
                out[0] += [query] * len(found)
                out[1] += found.tolist()
                out[2] += scores.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.int64())})

    groups = ("width", "part", "turn")
    met = left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(search, "query_id long, vec_id long, score long")
    met = met.withColumn("beyond", F.lit(""))
    large, asked_large = every.where("raw IS NOT NULL"), asked.where("raw IS NOT NULL")
    if not large.isEmpty() or not asked_large.isEmpty():
        met = met.unionByName(_large(large, asked, k)).unionByName(_large(xs, asked_large, k))
    best = met.groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "beyond")).alias("s")).select("query_id", "vec_id", "s.*")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _large(xs: DataFrame, qs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score, beyond): each query's k best among xs, block by block, by Python's integers."""
    parts, rounds = max(1, -(-xs.count() // BLOCK)), max(1, -(-qs.count() // QUERIES))
    width = F.coalesce(F.size("v"), F.size("raw")).alias("width")
    left = xs.select("id", "v", "raw", width, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("turn"))
    right = qs.select("id", "v", "raw", width, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(rounds)).cast("int").alias("turn"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def search(_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
        own = [(r["id"], _exact(r["v"], r["raw"])) for r in a.to_pylist()]
        out: list[tuple] = []
        for r in b.to_pylist():
            q, best = _exact(r["v"], r["raw"]), {}
            for i, x in own:
                if i != r["id"]:
                    score = sum(map(mul, q, x))
                    best[i] = max(score, best.get(i, score))
            out += [(r["id"], i, *_told(score)) for i, score in sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k]]
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "vec_id", "score", "beyond"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)})

    groups = ("width", "part", "turn")
    return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(search, "query_id long, vec_id long, score long, beyond string")


#: By brute force in DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, x.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
