"""Clusters of duplicate functions, and forks between files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import cluster_id
from ..functions.sequences import seq_divergence, seq_ratio
from ..operators.graph import FEW, components
from ..operators.similarity import DUPLICATE_LADDER, banded_pairs
from ..plans.tables import stash

#: Names that say nothing.
COMMON = ("require", "parse_args", "main", "close", "count")


def _keyed(symbols: DataFrame) -> DataFrame:
    """With label, the name in reports, and key, which sorts by path and position."""
    label = F.concat("path", F.lit(":"), "qualname", F.when(F.col("ordinal") > 0, F.concat(F.lit("#"), "ordinal")).otherwise(""))
    return symbols.withColumn("label", label).withColumn("key", F.struct("path", "position")).withColumn("digest", F.sha2("normalized", 256))


def _same_name(records: DataFrame, residual: str) -> DataFrame:
    l, r = records.where(~F.col("name").isin(*COMMON)).alias("l"), records.alias("r")
    return l.join(r, F.expr(f"l.name = r.name AND l.key < r.key AND {residual}")).select(F.col("l.key").alias("a"), F.col("r.key").alias("b"))


def _scored(pairs: DataFrame, records: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs that reach it; the length gate is native, and the earlier record goes first, since the ratio has a direction."""
    side = lambda n: records.select(F.col("key").alias(n), F.col("tokens").alias(f"{n}_tokens"), F.col("digest").alias(f"{n}_digest"))
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    gated = both.where(f"least(size(a_tokens), size(b_tokens)) >= greatest(size(a_tokens), size(b_tokens)) * {threshold}D")
    return gated.select("a", "b", "a_tokens", "b_tokens", F.expr("a_digest = b_digest").alias("same"), seq_ratio("a_tokens", "b_tokens", threshold).alias("similarity")).where(F.col("similarity") >= threshold)


def duplicates(symbols: DataFrame, threshold: float = 0.82, min_chars: int = 120, skip: tuple[str, ...] = COMMON) -> DataFrame:
    """(id, size, file_count, max_lines, max_sim, min_sim, priority, names, members), ordered. Clusters are components of equal bodies and of pairs
    whose similarity reaches the threshold; a cluster of skipped names only is left out."""
    records = stash(_keyed(symbols).where(~F.col("stub") & (F.length("normalized") >= min_chars)), "records")
    first = records.groupBy("digest").agg(F.min("key").alias("a"))
    exact = records.join(first, "digest").where("a <> key").select("a", F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    shaped = records.withColumn("band", F.expr("node_count div 12"))
    pairs = banded_pairs(shaped, ["arg_count", "top_signature"], "band", 2).unionAll(_same_name(records, "true"))
    near = _scored(pairs, records, threshold).where("NOT same").select("a", "b", "similarity")
    edges = stash(exact.unionAll(near), "edges")
    roots = stash(components(edges.select("a", "b"), few=FEW), "roots")
    lib = F.col("path").startswith("lib/")
    members = roots.join(records, roots["node"] == records["key"]).groupBy("root").agg(
        cluster_id(F.collect_list("label")).alias("id"),
        F.count("*").alias("size"),
        F.count_distinct("path").alias("file_count"),
        F.max("n_lines").alias("max_lines"),
        F.array_sort(F.collect_set("name")).alias("names"),
        F.array_sort(F.collect_list("label")).alias("members"),
        (F.bool_or(lib & (F.col("enclosing") == "module") & (F.col("name") == F.col("qualname"))) & F.bool_or(~lib & ~F.col("path").startswith("tests/"))).alias("lib_shared"),
    )
    scores = edges.join(roots, edges["a"] == roots["node"]).groupBy("root").agg(F.max("similarity").alias("max_sim"), F.min("similarity").alias("min_sim"))
    found = members.join(scores, "root").where(F.exists("names", lambda n: ~n.isin(*skip))).withColumn("priority", F.expr(DUPLICATE_LADDER))
    rank = F.expr("CASE priority WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END")
    return found.orderBy(rank, F.desc("size"), F.desc("max_lines"), "id").select("id", "size", "file_count", "max_lines", "max_sim", "min_sim", "priority", "names", "members")


def _fork_pairs(records: DataFrame, equal: list[str], width: int, threshold: float) -> DataFrame:
    banded = records.withColumn("band", F.expr(f"n_lines div {width}"))
    pairs = banded_pairs(banded, equal, "band", 4, "l.path <> r.path").unionAll(_same_name(records, "l.path <> r.path"))
    return _scored(pairs, records, threshold)


def forks(symbols: DataFrame, facts: DataFrame, threshold: float = 0.75, min_lines: int = 40, small_floor: int = 8, small_threshold: float = 0.9) -> DataFrame:
    """(channel, key, similarity, kind, name_match, signature_match, common, hints, left_only, right_only, a_imports_b, b_imports_a), ordered: pairs of
    functions of different files; the small channel has the shorter ones, at a stricter threshold."""
    if not 1 <= small_floor < min_lines:
        raise ValueError("small_floor must be from 1 to min_lines - 1")
    records = stash(_keyed(symbols).withColumn("n_lines", F.col("n_lines")), "records")
    main = _fork_pairs(records.where(F.col("n_lines") >= min_lines), ["top_signature"], 10, threshold).withColumn("channel", F.lit("main"))
    small = _fork_pairs(records.where((F.col("n_lines") >= small_floor) & (F.col("n_lines") < min_lines)), [], 5, small_threshold).withColumn("channel", F.lit("small"))
    pairs = stash(main.unionAll(small), "pairs").withColumn("d", seq_divergence("a_tokens", "b_tokens")).drop("a_tokens", "b_tokens")
    names = F.array_except(F.array_distinct(F.regexp_extract_all("normalized", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))), F.array(F.lit("_name"), F.lit("_arg")))
    side = lambda n: records.select(F.col("key").alias(n), *[c.alias(f"{n}_{k}") for k, c in {"label": F.col("label"), "name": F.col("name"), "shape": F.col("sig_shape"), "path": F.col("path"), "ids": names}.items()])
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    modules = imports_of(facts)
    for x, y in (("a", "b"), ("b", "a")):
        met = modules.select(F.col("path").alias(f"{x}_path"), F.col("target").alias(f"{y}_path"), F.lit(True).alias(f"{x}_imports_{y}"))
        both = both.join(met, [f"{x}_path", f"{y}_path"], "left")
    only = lambda x, y: F.slice(F.array_sort(F.array_except(f"{x}_ids", f"{y}_ids")), 1, 12)
    return both.select(
        "channel",
        F.array_join(F.array_sort(F.array("a_label", "b_label")), "::").alias("key"),
        F.round("similarity", 4).alias("similarity"),
        F.when(F.col("similarity") >= 0.95, "near_duplicate").otherwise("fork").alias("kind"),
        F.expr("a_name = b_name").alias("name_match"),
        F.expr("a_shape = b_shape").alias("signature_match"),
        F.col("d.common").alias("common"),
        F.col("d.hints").alias("hints"),
        only("a", "b").alias("left_only"),
        only("b", "a").alias("right_only"),
        F.coalesce("a_imports_b", F.lit(False)).alias("a_imports_b"),
        F.coalesce("b_imports_a", F.lit(False)).alias("b_imports_a"),
    ).orderBy("channel", F.desc("similarity"), "key")


def imports_of(facts: DataFrame) -> DataFrame:
    """(path, target), distinct: which file imports which; an import of a name under a module is one of the module, and of what holds it."""
    from ..operators.references import prefix_references
    from ..sources.files import module_name

    files = facts.select("path").distinct().select(F.col("path").alias("target"), module_name().alias("module")).where("module <> ''")
    imports = facts.where("kind = 'import'").select("path", F.col("value").alias("imported")).distinct()
    return prefix_references(imports, files, "imported", "module").where("path <> target").select("path", "target").distinct()
