"""Hard negatives by a vantage-point tree over norm-augmented vectors.

Vectors are held as integers, floor(256 * x) of every component (pivot_topk.integers). With M the greatest norm, a row x becomes x' = (x, sqrt(M^2 - |x|^2)) and an anchor q becomes q' = (q, 0), so that
|q' - x'|^2 = |q|^2 + M^2 - 2 q . x: higher scores are nearer, and scores between two bounds are distances in an annulus around q'.

The index has two levels. The upper part of the tree is fitted on at most SAMPLE vectors (those of smallest hash); its leaves are cells, and every row is in one cell, by its
distances to the vantage points on the way. A cell of more than `block_rows` rows is dealt into blocks by a hash, so that a group of copies fills several. A task holds one block, builds
the lower part of the tree over it (medians, so that copies part too, with the range of distances on either side of a vantage point) and takes one lot of anchors, at most ASKS.
It bounds the distance of every leaf for all of its anchors, takes an anchor's leaves nearest first, beginning at the annulus's inner edge, and stops when no leaf left can
hold a row before the k-th found so far. Scores are integers, exact; distances are taken with a margin for rounding.

Each search goes to the nearest cell that the annulus meets first. The k-th score found there narrows the annulus for the second step, which goes to the cells that still meet it. `mine` searches twice: an anchor's
positives (nearest rows of its label, no inner edge), then for each of them the nearest rows of other labels within the window of scores that it sets.

Vectors with components so large that scores might not fit into a long are compared by Python's integers, in blocks of their own, with every other; scores beyond a long are ranked as they
are and told as the nearest long.

Nulls, empties, ties: rows without an id or a label, or whose vector is null, empty or holds a null or a component that isn't finite, take no part. Of rows with the same id one takes part: that of the
smallest label, then the smallest vector. Vectors of different length never meet. Ties in score go to the smaller id. A positive of which no row is in the window gives no rows. Columns other than the three play no part,
whatever their names. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import broadcast_if_small
from .common import scratch, stash
from .pivot_topk import DIGITS, LARGEST, _exact, _told, integers

#: Vectors that the upper tree is fitted on, its greatest depth, and components of its vantage points together.
SAMPLE, DEPTH, COMPONENTS = 8192, 12, 1 << 22
#: Rows of a block at most, and components of its vectors together; rows of a leaf of the lower tree; anchors that a task takes.
BLOCK, BLOCK_COMPONENTS, LEAF, ASKS = 8192, 1 << 22, 64, 2048
#: Leaves that are scored together; four times as many each time.
STEP = 4
BROADCAST_ROWS = 500_000
#: The cell of vectors that are compared by Python's integers.
LARGE = -1


def block_rows(width: int) -> int:
    return max(64, min(BLOCK, BLOCK_COMPONENTS // max(1, width)))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Between the rows of a and of b."""
    square = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def augmented(x: np.ndarray, norm: int | None) -> np.ndarray:
    """Rows with what their square lacks of norm as one more component; anchors, norm None, with zero."""
    x = x.astype(np.float64)
    more = np.zeros(len(x)) if norm is None else np.sqrt(np.maximum(norm - (x * x).sum(axis=1), 0))
    return np.column_stack([x, more])


def _slack(norm: float, a: np.ndarray) -> float:
    """What rounding can do to a distance: squares err by far less than their size / 2**40, their roots most near zero."""
    return 2.0**-19 * np.sqrt(max(1.0, norm, float((a * a).sum(axis=1).max(initial=0))))


class Upper:
    """The upper tree of one length of vectors: nodes in order, each with its vantage point and the median distance; the cells with their ways."""

    def __init__(self, sample: np.ndarray, rows: int):
        limit = block_rows(sample.shape[1] - 1)
        most = max(1, COMPONENTS // sample.shape[1])
        self.points, self.medians, self.ways = [], [], []
        self.children: list[list[int]] = []  # of a node: inner, outer; cell c as -1 - c
        waiting = [(np.arange(len(sample)), [], None)]
        while waiting:
            own, way, above = waiting.pop(0)
            if len(own) * rows > limit * len(sample) and len(own) >= 8 and len(way) < DEPTH and len(self.points) < most:
                point = sample[own[np.argmax(_distances(sample[own[:1]], sample[own])[0])]]
                d = _distances(point[None], sample[own])[0]
                median = float(np.median(d))
                inner = d <= median
                if 0 < inner.sum() < len(own):
                    node = len(self.points)
                    self.points.append(point)
                    self.medians.append(median)
                    self.children.append([0, 0])
                    waiting += [(own[inner], [*way, (node, 0)], (node, 0)), (own[~inner], [*way, (node, 1)], (node, 1))]
                    if above:
                        self.children[above[0]][above[1]] = node
                    continue
            if above:
                self.children[above[0]][above[1]] = -1 - len(self.ways)
            self.ways.append(way)

    def _to_points(self, x: np.ndarray) -> np.ndarray:
        return _distances(x, np.array(self.points)) if self.points else np.zeros((len(x), 0))

    def cells(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row."""
        d, out = self._to_points(x), np.zeros(len(x), np.int64)
        if not self.points:
            return out
        at = np.zeros(len(x), np.int64)
        kids, medians = np.array(self.children), np.array(self.medians)
        while (live := np.flatnonzero(at >= 0)).size:
            node = at[live]
            at[live] = kids[node, (d[live, node] > medians[node]).astype(int)]
        return -1 - at

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and cell the least and the greatest distance that a row of the cell can have."""
        d = self._to_points(q)
        low, high = np.zeros((len(q), len(self.ways))), np.full((len(q), len(self.ways)), np.inf)
        for c, way in enumerate(self.ways):
            for node, outer in way:
                if outer:
                    np.maximum(low[:, c], self.medians[node] - d[:, node], out=low[:, c])
                else:
                    np.maximum(low[:, c], d[:, node] - self.medians[node], out=low[:, c])
                    np.minimum(high[:, c], d[:, node] + self.medians[node], out=high[:, c])
        return low, high


class Lower:
    """The tree over one block: rows in the order of its leaves."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.points, self.ranges, self.children, self.leaves = [], [], [], []
        waiting = [(0, len(x), None)]
        while waiting:
            begin, end, above = waiting.pop(0)
            own = self.order[begin:end]
            if len(own) > LEAF:
                node, cut = len(self.points), len(own) // 2
                point = x[own[np.argmax(_distances(x[own[:1]], x[own])[0])]]
                d = _distances(point[None], x[own])[0]
                by = np.argsort(d, kind="stable")
                self.order[begin:end], d = own[by], d[by]
                self.points.append(point)
                self.ranges.append((d[0], d[cut - 1], d[cut], d[-1]))
                self.children.append([0, 0])
                waiting += [(begin, begin + cut, (node, 0)), (begin + cut, end, (node, 1))]
                mark = node
            else:
                mark = -1 - len(self.leaves)
                self.leaves.append((begin, end))
            if above:
                self.children[above[0]][above[1]] = mark

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each anchor and leaf the least and the greatest distance of the leaf's rows."""
        low, high = np.zeros((len(self.leaves), len(q))), np.full((len(self.leaves), len(q)), np.inf)
        if self.points:
            d, at = _distances(np.array(self.points), q), {0: (np.zeros(len(q)), np.full(len(q), np.inf))}
            for node, (kids, r) in enumerate(zip(self.children, self.ranges, strict=True)):
                least, most = at.pop(node)
                for kid, near, far in ((kids[0], r[0], r[1]), (kids[1], r[2], r[3])):
                    both = np.maximum(least, np.maximum(d[node] - far, near - d[node])), np.minimum(most, d[node] + far)
                    if kid >= 0:
                        at[kid] = both
                    else:
                        low[-1 - kid], high[-1 - kid] = both
        return low.T, high.T


def search_block(asks: list[tuple], q: np.ndarray, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, norm: int, k: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """For each ask (id, label, least score or None, greatest or None) of the anchor in that row of q: ids and scores of its k best rows in the block, and how many rows were scored."""
    tree = Lower(augmented(x, norm))
    ids, labels, x = ids[tree.order], labels[tree.order], x[tree.order]
    exact = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * x.shape[1] < 2**52  # then products in doubles are exact
    xs, qs = (x.astype(np.float64), q.astype(np.float64)) if exact else (x, q)
    aq = augmented(q, None)
    slack, squares = _slack(norm, aq), (aq * aq).sum(axis=1)
    low, high = tree.bounds(aq)
    begins, ends = np.array(tree.leaves).T
    for i, (own, label, least, most) in enumerate(asks):
        reach = lambda s: np.sqrt(max(0.0, squares[i] + norm - 2.0 * s))  # noqa: B023, E731
        inner, outer = 0.0 if most is None else reach(most), np.inf if least is None else reach(least)
        left = np.flatnonzero((low[i] - slack <= outer) & (high[i] + slack >= inner))
        left = left[np.argsort(np.maximum(low[i][left], inner), kind="stable")]
        found_ids, found, done, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, STEP
        while len(left):
            now, left = left[:step], left[step:]
            rows = np.concatenate([np.arange(begins[j], ends[j]) for j in now])
            rows = rows[(labels[rows] == label) == same]
            rows = rows[ids[rows] != own]
            done += len(rows)
            score = (xs[rows] @ qs[i]).astype(np.int64)
            fits = np.ones(len(rows), bool) if least is None else score >= least
            if most is not None:
                fits &= score <= most
            found_ids, found = np.concatenate([found_ids, ids[rows[fits]]]), np.concatenate([found, score[fits]])
            best = np.lexsort((found_ids, -found))[:k]
            found_ids, found = found_ids[best], found[best]
            if len(found) == k:
                left = left[low[i][left] - slack <= reach(int(found[-1]))]
            step *= 4
        yield found_ids, found, done


def window(score: int, like: tuple[int, int]) -> tuple[int, int]:
    """The least and the greatest n with like[0] * score <= 100 * n <= like[1] * score."""
    return -(-like[0] * score // 100), like[1] * score // 100


def _untold(score: int, beyond: str) -> int:
    """What pivot_topk._told has told."""
    return score if not beyond else int(beyond, 16) - (0 if score > 0 else 1 << 4 * DIGITS - 1)


ASK = "anchor long, v array<long>, raw array<double>, label long, positive long, score long, beyond string, floor long, width int"
FOUND = "anchor long, positive long, id long, score long, beyond string"


class Index:
    """Rows (id, label, v, raw) by cell and block, in a written table, and what searches need to know of them."""

    def __init__(self, rows: DataFrame):
        rows = rows.withColumn("width", F.coalesce(F.size("v"), F.size("raw")))
        plain = rows.where("v IS NOT NULL")
        self.norm = plain.agg(F.max(F.expr("aggregate(v, 0L, (s, x) -> s + x * x)"))).first()[0] or 0
        by_width: dict[int, list] = {}
        for r in plain.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).select("v").collect():
            by_width.setdefault(len(r.v), []).append(r.v)
        n, taken = plain.count(), sum(map(len, by_width.values()))
        trees = {w: Upper(augmented(np.array(s, np.int64), self.norm), -(-n * len(s) // taken)) for w, s in by_width.items()}
        self.trees, norm = rows.sparkSession.sparkContext.broadcast(trees), self.norm
        sent = self.trees

        def celled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = np.zeros(len(b), np.int32)
                widths, v = np.asarray(b["width"]), b["v"]
                for w in np.unique(widths):
                    at = np.flatnonzero((widths == w) & np.asarray(v.is_valid()))
                    if len(at) and w in sent.value:
                        cells[at] = sent.value[w].cells(augmented(np.asarray(v.take(pa.array(at)).flatten()).reshape(-1, w), norm))
                cells[np.asarray(v.is_null())] = LARGE
                yield b.append_column("cell", pa.array(cells, pa.int32()))

        dealt = stash(rows.mapInArrow(celled, "id long, label long, v array<long>, raw array<double>, width int, cell int"), "cells")
        most = F.greatest(F.lit(64), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_COMPONENTS) / F.col("width"))))
        self.cells = stash(dealt.groupBy("width", "cell").agg(F.count("*").alias("n")).withColumn("blocks", F.ceil(F.col("n") / most).cast("int")), "blocks")
        block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block")
        self.rows = stash(dealt.join(broadcast_if_small(self.cells.select("width", "cell", "blocks"), BROADCAST_ROWS), ["width", "cell"]).select(*dealt.columns, block), "index")
        self.any_large = not self.cells.where(f"cell = {LARGE}").isEmpty()

    def route(self, asks: DataFrame, like: tuple[int, int] | None, first: bool) -> DataFrame:
        """The asks with a cell each: the nearest that the annulus meets, or all others that it meets. An ask that isn't compared by bounds goes to every cell, in the second step."""
        sent, norm, any_large = self.trees, self.norm, self.any_large

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows, cells = [], []
                width, v = np.asarray(b["width"]), b["v"]
                valid = np.asarray(v.is_valid())
                for w in np.unique(width):
                    tree = sent.value.get(w) or Upper(np.zeros((0, w + 1)), 0)
                    at = np.flatnonzero((width == w) & valid)
                    if len(at):
                        q = augmented(np.asarray(v.take(pa.array(at)).flatten()).reshape(-1, w), None)
                        low, high = tree.bounds(q)
                        slack, squares = _slack(norm, q), (q * q).sum(axis=1)
                        for j, i in enumerate(at):
                            least = most = None
                            if like:
                                least, most = window(_untold(b["score"][i].as_py(), b["beyond"][i].as_py()), like)
                                if least > most:
                                    continue
                            reach = lambda s: np.sqrt(max(0.0, squares[j] + norm - 2.0 * float(s)))  # noqa: B023, E731
                            inner, outer = 0.0 if most is None else reach(most), np.inf if least is None else reach(least)
                            meets = np.flatnonzero((low[j] - slack <= outer) & (high[j] + slack >= inner))
                            home = meets[np.lexsort((high[j][meets], np.maximum(low[j][meets], inner)))[:1]]
                            if not first:
                                floor = b["floor"][i].as_py()
                                meets = meets[meets != home] if floor is None else meets[(meets != home) & (low[j][meets] - slack <= reach(floor))]
                            here = home if first else meets
                            cells += here.tolist() + [LARGE] * (any_large and not first)
                            rows += [i] * (len(cells) - len(rows))
                    if not first:
                        for i in np.flatnonzero((width == w) & ~valid):
                            cells += [*range(len(tree.ways)), *[LARGE] * any_large]
                            rows += [i] * (len(cells) - len(rows))
                yield b.take(pa.array(rows, pa.int64())).append_column("cell", pa.array(cells, pa.int32()))

        return asks.mapInArrow(routed, f"{ASK}, cell int")

    def visit(self, routed: DataFrame, like: tuple[int, int] | None, k: int) -> DataFrame:
        """Each ask's k best rows of every block of its cells: other rows of its label, or with like of other labels within the window."""
        place, norm, same = ("width", "cell", "block"), self.norm, like is None
        asks = stash(routed.join(broadcast_if_small(self.cells.select("width", "cell", "blocks"), BROADCAST_ROWS), ["width", "cell"]), "asks")
        asks = asks.withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
        turns = asks.groupBy(*place).agg(F.ceil(F.count("*") / ASKS).cast("int").alias("turns"))
        turns = stash(turns, "turns")
        left = self.rows.join(turns, list(place)).withColumn("turn", F.explode(F.expr("sequence(0, turns - 1)"))).drop("turns")
        right = asks.join(turns, list(place)).withColumn("turn", F.expr("CAST(pmod(xxhash64(anchor, positive), turns) AS INT)")).drop("turns")

        def search(_: tuple, a: pa.Table, b: pa.Table) -> pa.Table:
            out: list[tuple] = []
            if len(a) and len(b):
                a, b = a.combine_chunks(), b.combine_chunks()
                if a["v"].null_count:
                    own, bounded = [(r["id"], r["label"], _exact(None, r["raw"])) for r in a.select(["id", "label", "raw"]).to_pylist()], None
                else:
                    width = a["width"][0].as_py()
                    x = np.asarray(a["v"].combine_chunks().flatten()).reshape(-1, width)
                    ids, labels = np.asarray(a["id"]), np.asarray(a["label"])
                    own, bounded = None, np.flatnonzero(np.asarray(b["v"].is_valid()))
                asked = b.drop_columns(["v", "raw"]).to_pylist()
                spans = [window(_untold(r["score"], r["beyond"]), like) if like else (None, None) for r in asked]
                if bounded is not None and len(bounded):
                    low = [spans[i][0] if asked[i]["floor"] is None else max(asked[i]["floor"], spans[i][0] if like else asked[i]["floor"]) for i in bounded]
                    q = np.asarray(b["v"].combine_chunks().take(pa.array(bounded)).flatten()).reshape(-1, width)
                    # Windows may lie beyond any score that can be here; as longs they keep their meaning.
                    fit = lambda s: None if s is None else max(-(1 << 63), min((1 << 63) - 1, s))
                    plain = [(asked[i]["anchor"], asked[i]["label"], fit(s), fit(spans[i][1])) for i, s in zip(bounded, low, strict=True)]
                    for i, (found, scores, _n) in zip(bounded, search_block(plain, q, ids, labels, x, norm, k, same), strict=True):
                        out += [(asked[i]["anchor"], asked[i]["positive"], f, s, "") for f, s in zip(found.tolist(), scores.tolist(), strict=True)]
                rest = range(len(asked)) if bounded is None else np.flatnonzero(~np.asarray(b["v"].is_valid()))
                if len(rest) and own is None:
                    own = list(zip(ids.tolist(), labels.tolist(), x.tolist(), strict=True))
                for i in rest:
                    r, (low, high) = asked[i], spans[i]
                    q = _exact(b["v"][int(i)].as_py(), b["raw"][int(i)].as_py())
                    met = [(sum(s * t for s, t in zip(q, y, strict=True)), j) for j, label, y in own if j != r["anchor"] and (label == r["label"]) == same]
                    best = sorted((-s, j) for s, j in met if not like or low <= s <= high)[:k]
                    out += [(r["anchor"], r["positive"], j, *_told(-s)) for s, j in best]
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.table({n: pa.array(c, t) for n, c, t in zip(("anchor", "positive", "id", "score", "beyond"), columns, kinds, strict=True)})

        groups = (*place, "turn")
        return left.groupBy(*groups).cogroup(right.groupBy(*groups)).applyInArrow(search, FOUND)

    def best(self, asks: DataFrame, like: tuple[int, int] | None, k: int) -> DataFrame:
        """(anchor, positive, rank, id, score, beyond): each ask's k best rows of the whole table."""
        near = stash(self.visit(self.route(asks, like, first=True), like, k), "near")
        order = W.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.desc("beyond"), "id")
        reached = near.withColumn("rank", F.row_number().over(order)).where(f"rank = {k} AND beyond = ''")
        same = (F.col("anchor") == F.col("_a")) & F.col("positive").eqNullSafe(F.col("_p"))
        narrowed = asks.drop("floor").join(reached.select(F.col("anchor").alias("_a"), F.col("positive").alias("_p"), F.col("score").alias("floor")), same, "left").select(*asks.columns)
        every = near.unionByName(self.visit(self.route(narrowed, like, first=False), like, k))
        return stash(every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")


def usable(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v, raw), a row for each id: v holds the integers, or raw the components where LARGEST is reached."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    small = F.forall(x, lambda c: F.abs(c.cast("double")) * F.sqrt(F.size(x)) < LARGEST)
    rows = vectors.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (F.size(x) > 0)).where(finite)
    rows = rows.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("bigint").alias("label"), F.when(small, integers(x)).alias("v"), F.when(~small, x.cast("array<double>")).alias("raw"))
    return rows.groupBy("id").agg(F.min(F.struct("label", F.coalesce("raw", F.col("v").cast("array<double>")).alias("x"), "v", "raw")).alias("r")).select("id", "r.label", "r.v", "r.raw")


def mine(vectors: DataFrame, anchors: str, positives: int = 5, negatives: int = 10, like: tuple[int, int] = (30, 90), key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(anchor_id, positive_id long, rank int, negative_id, positive_score, negative_score long). anchors: SQL condition on id."""
    with scratch():
        rows = stash(usable(vectors, key, vector, label), "vectors")
        index = Index(rows)
        none = F.lit(None).cast("bigint")
        asks = rows.where(anchors).select(F.col("id").alias("anchor"), "v", "raw", "label", none.alias("positive"), none.alias("score"), F.lit("").alias("beyond"), none.alias("floor"), F.coalesce(F.size("v"), F.size("raw")).alias("width"))
        asks = stash(asks, "anchors")
        own = index.best(asks, None, positives).select("anchor", F.col("id").alias("positive"), "score", "beyond")
        pairs = stash(asks.drop("positive", "score", "beyond").join(own, "anchor").select(*asks.columns), "pairs")
        found = index.best(pairs, like, negatives).select("anchor", "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        found = found.join(own.select("anchor", "positive", F.col("score").alias("positive_score")), ["anchor", "positive"])
        out = found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank", "negative_id", "positive_score", "negative_score")
        return stash(out, "negatives", keep=True)


#: By brute force in DuckDB.
SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, x.vec_id AS id, a.label = x.label AS same, CAST(list_sum(list_transform(list_zip(a.v, x.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v a JOIN v x ON a.vec_id <> x.vec_id AND len(a.v) = len(x.v) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""
