"""Connected components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import discard, scratch, shuffled, stash

#: Links that one task may hold.
FEW = 200_000


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of the links (u, v) of one task."""
    root: dict = {}
    said: dict = {}  # a node by what stands for it

    def known(x):
        """What stands for a node: a struct's values, which can be compared, null first."""
        k = tuple((v is not None, v) if v is not None else (False,) for v in x.values()) if isinstance(x, dict) else x
        said[k] = x
        return k

    def find(x):
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    kind = None
    for b in batches:
        kind = b.schema.field(0).type
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            low, high = sorted((find(known(u)), find(known(v))))
            root[high] = low
    if root:
        nodes = list(root)
        yield pa.RecordBatch.from_arrays([pa.array([said[x] for x in nodes], kind), pa.array([said[find(x)] for x in nodes], kind)], names=["node", "root"])


def components(edges: DataFrame, max_rounds: int = 60, few: int = 0) -> DataFrame:
    """Connected components of undirected links.

    edges: (a, b). Returns (node, root), root being the smallest node of the component, for every
    node that has a link to another. Alternating large-star and small-star rounds: each makes linear
    work, and their number is logarithmic in the length of chains. Rounds are written tables; one goes when the next is written.
    A graph of no more than few links, counted, is joined up in one task of Python instead.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    with scratch():
        pairs, before = stash(pairs, "links"), None
        if few and pairs.count() <= few:
            kind = pairs.schema["u"].dataType.simpleString()
            return stash(pairs.coalesce(1).mapInArrow(_small, f"node {kind}, root {kind}"), "components", keep=True)
        for _ in range(max_rounds):
            both = pairs.unionAll(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = both.join(shuffled(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = stash(large, "large")
            least = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(shuffled(least), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            last, pairs = pairs, stash(small.where("u <> v").distinct(), "small")
            discard(last, large)
            now = pairs.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
            if now == before:
                break
            before = now
        else:
            raise RuntimeError("components did not settle")
        roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        return stash(roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct()), "components", keep=True)
