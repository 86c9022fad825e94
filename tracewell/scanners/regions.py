"""Regions that repeat, that re-implement a helper, and functions that are twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cluster_id, short_hash
from ..functions.sequences import seq_coverage, seq_ratio
from ..operators.graph import FEW, components
from ..operators.similarity import banded_pairs
from ..plans.tables import stash

#: Calls that say nothing of what a helper does.
GENERIC = (
    "bool", "dict", "enumerate", "float", "int", "len", "list", "max", "min", "print", "range", "set", "sorted", "str", "sum", "tuple", "zip",
    "AssertionError", "KeyError", "RuntimeError", "TypeError", "ValueError",
)
SHARED_LADDER = """CASE WHEN short THEN IF(file_count >= 2 OR size >= 3, 'high', 'medium')
  WHEN file_count >= 2 AND max_lines >= 15 AND max_sim >= 0.9 THEN 'high' WHEN max_risk >= 0.7 THEN 'high' WHEN file_count >= 2 THEN 'medium' ELSE 'low' END"""


def _keyed(regions: DataFrame) -> DataFrame:
    label = F.concat_ws(":", "path", "parent", F.concat_ws("-", "start_line", "end_line"))
    return regions.withColumn("label", label).withColumn("key", F.struct("path", "parent", "start_line", "end_line"))


def _sides(pairs: DataFrame, records: DataFrame, *columns: str) -> DataFrame:
    for n in ("a", "b"):
        pairs = pairs.join(records.select(F.col("key").alias(n), *[F.col(c).alias(f"{n}_{c}") for c in columns]), n)
    return pairs


def shared(regions: DataFrame, threshold: float = 0.82) -> DataFrame:
    """(id, size, file_count, max_lines, max_sim, min_sim, semantic_risk, signals, hints, priority, members), ordered: components of equal or similar
    shared regions, and of short risky ones with the same signature whose blocks cover each other."""
    records = stash(_keyed(regions), "regions")
    own = records.where("channel = 'shared'").withColumn("digest", F.sha2(F.array_join("tokens", " "), 256)).withColumn("band", F.expr("n_statements div 8"))
    exact = own.join(own.groupBy("digest").agg(F.min("key").alias("a")), "digest").where("a <> key").select("a", F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    calls = "size(array_intersect(l.calls, r.calls)) > 0 AND size(array_intersect(l.calls, r.calls)) >= 0.5D * size(array_union(l.calls, r.calls))"
    near = _sides(banded_pairs(own, ["control_shape"], "band", 2, calls).distinct(), own, "tokens")
    near = near.where(f"least(size(a_tokens), size(b_tokens)) >= greatest(size(a_tokens), size(b_tokens)) * {threshold}D").select("a", "b", seq_ratio("a_tokens", "b_tokens", threshold).alias("similarity")).where(F.col("similarity") >= threshold)
    risky = records.where("channel = 'short_risky'")
    l, r = risky.alias("l"), risky.alias("r")
    met = l.join(r, F.expr("l.short_signature = r.short_signature AND l.key < r.key AND abs(size(l.tokens) - size(r.tokens)) <= greatest(size(l.tokens), size(r.tokens)) div 2"))
    short = met.select(F.col("l.key").alias("a"), F.col("r.key").alias("b"), seq_coverage(F.col("l.tokens"), F.col("r.tokens"), F.expr("least(size(l.tokens), size(r.tokens))")).alias("similarity")).where("similarity >= 0.5D")
    edges = stash(exact.unionAll(near).unionAll(short).groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "edges")
    roots = stash(components(edges.select("a", "b"), few=FEW), "roots")
    members = roots.join(records, roots["node"] == records["key"])
    found = members.groupBy("root").agg(
        cluster_id(F.collect_list("label")).alias("id"), F.count("*").alias("size"), F.count_distinct("path").alias("file_count"), F.max("n_lines").alias("max_lines"), F.max("risk").alias("max_risk"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("signals")))).alias("signals"), F.array_sort(F.collect_list("label")).alias("members"), F.bool_and(F.col("channel") == "short_risky").alias("short"),
    )
    named = members.select("root", "key", F.posexplode("calls").alias("i", "call")).groupBy("root", "call").agg(F.count("*").alias("n"), F.min(F.struct("key", "i")).alias("first")).where("n >= 2")
    hints = named.groupBy("root").agg(F.expr("transform(slice(sort_array(collect_list(struct(-n AS n, first, call))), 1, 8), x -> x.call)").alias("hints"))
    scores = edges.join(roots, edges["a"] == roots["node"]).groupBy("root").agg(F.round(F.max("similarity"), 4).alias("max_sim"), F.round(F.min("similarity"), 4).alias("min_sim"))
    out = found.join(scores, "root").join(hints, "root", "left").withColumn("priority", F.expr(SHARED_LADDER))
    rank = F.expr("CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END")
    columns = ["id", "size", "file_count", "max_lines", "max_sim", "min_sim", F.round("max_risk", 2).alias("semantic_risk"), "signals", F.coalesce("hints", F.array().cast("array<string>")).alias("hints"), "priority", "members"]
    return out.orderBy(rank, F.desc("size"), F.desc("max_lines"), "id").select(*columns)


def helpers(regions: DataFrame, bodies: DataFrame, threshold: float = 0.6, shared_paths: tuple[str, ...] = ("lib",)) -> DataFrame:
    """(id, canonical, size, file_count, coverage, priority, members): functions and the helper regions that hold most of their tokens without calling
    them. Any pair has to share a token that is rare among the functions', so the rarest of each are what is joined."""
    records = stash(_keyed(regions).where("channel = 'helper'"), "helpers")
    known = stash(bodies.where("NOT covered AND NOT qualname LIKE '%\\\\_\\\\_init\\\\_\\\\_'").withColumn("fkey", F.struct("path", "qualname", "start_line")), "canonical")
    # A region covers a share t of a function's tokens only if it has that share of them at least; with n of them distinct by occurrence, one of
    # any n - ceil(t * n) + 1 is among those. The rarest are taken.
    numbered = lambda df, k: df.select(k, F.explode("tokens").alias("token")).groupBy(k, "token").agg(F.count("*").alias("c")).select(k, "token", F.explode(F.expr("sequence(1, CAST(c AS INT))")).alias("o"))
    theirs, ours = stash(numbered(known, "fkey"), "theirs"), numbered(records, "key")
    spread = ours.groupBy("token", "o").agg(F.count("*").alias("df"))
    ranked = theirs.join(spread, ["token", "o"], "left").withColumn("place", F.expr("row_number() OVER (PARTITION BY fkey ORDER BY coalesce(df, 0), token, o)")).withColumn("n", F.expr("count(*) OVER (PARTITION BY fkey)"))
    met = ranked.where(f"place <= n - ceil(n * {threshold}D - 1e-9) + 1").join(ours, ["token", "o"]).select("fkey", "key").distinct()
    both = met.join(records, "key").join(known.select("fkey", F.col("path").alias("f_path"), "qualname", "name", F.col("tokens").alias("f_tokens"), F.col("calls").alias("f_calls")), "fkey")
    both = both.where(f"NOT (f_path = path AND (qualname = parent OR startswith(parent, concat(qualname, '.')))) AND size(tokens) >= {threshold}D * size(f_tokens) AND NOT array_contains(calls, name)")
    both = both.withColumn("coverage", seq_coverage("tokens", "f_tokens", F.size("f_tokens"))).where(F.col("coverage") >= threshold)
    both = both.withColumn("anchor", F.size(F.array_except(F.array_intersect("calls", "f_calls"), F.array(*map(F.lit, GENERIC)))) > 0)
    found = both.groupBy("fkey", "f_path", "qualname").agg(F.array_sort(F.collect_list("label")).alias("members"), F.count("*").alias("size"), F.count_distinct(F.when(F.col("path") != F.col("f_path"), F.col("path"))).alias("others"), F.max("coverage").alias("best"), F.bool_or("anchor").alias("anchor"))
    in_shared = F.exists(F.array(*map(F.lit, shared_paths)), lambda p: (F.col("f_path") == p) | F.col("f_path").startswith(F.concat(p, F.lit("/"))))
    found = found.withColumn("lib", in_shared).withColumn("priority", F.expr("CASE WHEN best >= 0.85 AND others > 0 AND lib AND anchor THEN 'high' WHEN best >= 0.7 AND (lib OR anchor) THEN 'medium' ELSE 'low' END"))
    return found.select(short_hash("f_path", "qualname", F.array_join("members", "\n")).alias("id"), F.concat_ws(":", "f_path", "qualname").alias("canonical"), "size", (F.col("others") + 1).alias("file_count"), F.round("best", 4).alias("coverage"), "priority", "members")


def twins(bodies: DataFrame, threshold: float = 0.85) -> DataFrame:
    """(id, size, file_count, max_sim, priority, members): functions with method calls whose bodies match over the longer one. Bands of eight
    statements; two bands apart only meet if the one between has a function. Two of one file alone are left out."""
    own = bodies.where("api_calls AND NOT qualname LIKE '%\\\\_\\\\_init\\\\_\\\\_'").withColumn("key", F.struct("path", "qualname", "start_line")).withColumn("band", F.expr("n_statements div 8"))
    own = stash(own, "functions")
    apart = "NOT (l.path = r.path AND (l.qualname = r.qualname OR startswith(l.qualname, concat(r.qualname, '.')) OR startswith(r.qualname, concat(l.qualname, '.'))))"
    gate = f"least(size(l.tokens), size(r.tokens)) >= {threshold}D * greatest(size(l.tokens), size(r.tokens))"
    pairs = _sides(banded_pairs(own, [], "band", 2, f"{apart} AND {gate}"), own, "tokens", "band")
    between = own.select(F.col("band").alias("middle")).distinct()
    pairs = pairs.withColumn("middle", F.expr("IF(abs(a_band - b_band) = 2, (a_band + b_band) div 2, a_band)")).join(between, "middle", "left_semi")
    counts = lambda x: f"map_from_entries(transform(array_distinct({x}), t -> struct(t, size(filter({x}, y -> y = t)))))"
    bound = f"aggregate(map_entries({counts('a_tokens')}), 0, (s, e) -> s + least(e.value, size(filter(b_tokens, y -> y = e.key))))"
    pairs = pairs.where(f"{bound} >= {threshold}D * greatest(size(a_tokens), size(b_tokens))")
    edges = pairs.select("a", "b", seq_coverage("a_tokens", "b_tokens", F.expr("greatest(size(a_tokens), size(b_tokens))")).alias("similarity")).where(F.col("similarity") >= threshold)
    edges = stash(edges, "twins")
    roots = stash(components(edges.select("a", "b"), few=FEW), "twin-roots")
    label = F.concat_ws(":", "path", "qualname")
    found = roots.join(own, roots["node"] == own["key"]).groupBy("root").agg(cluster_id(F.collect_list(label)).alias("id"), F.count("*").alias("size"), F.count_distinct("path").alias("file_count"), F.array_sort(F.collect_list(label)).alias("members"))
    scores = edges.join(roots, edges["a"] == roots["node"]).groupBy("root").agg(F.round(F.max("similarity"), 4).alias("max_sim"))
    found = found.where("NOT (size = 2 AND file_count = 1)").join(scores, "root")
    return found.select("id", "size", "file_count", "max_sim", F.when((F.col("file_count") >= 2) | (F.col("size") >= 3), "high").otherwise("medium").alias("priority"), "members")
