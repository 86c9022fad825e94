"""Functions that overlap the shared library's."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names that say nothing.
BOILERPLATE = ("main", "parse_args", "require", "close", "count", "load_ignore", "_write_json", "checkpoint_step", "stratum_name")


def tag_tokens(text: Column | str) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[_\-.,;:()\[\]{}/\s]+", " "), " "), lambda x: x != "")


def _tag_similarity(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([1.0 if list(p) == list(q) else SequenceMatcher(None, list(p), list(q), autojunk=False).ratio() for p, q in zip(x, y, strict=True)])

    return run(a, b)


def _matches(symbols: DataFrame, doc_threshold: float, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The functions and direct methods outside lib (of path alone if one is given), and these with each of those in lib/*.py that has their name; or, if none has, whose tag line is similar."""
    own = symbols.where("enclosing IN ('module', 'class')").select("path", "name", "qualname", "position", "sig_shape", tag_tokens("doc").alias("tag"))
    label = F.concat("path", F.lit(":"), "qualname")
    index = own.where(F.col("path").rlike("^lib/[^/]*\\.py$")).select(label.alias("lib"), F.col("path").alias("lib_path"), F.col("position").alias("lib_position"), F.col("name").alias("lib_name"), F.col("sig_shape").alias("lib_shape"), F.col("tag").alias("lib_tag"))
    local = own.where(~F.col("path").startswith("lib/") & ~F.col("path").startswith("tests/") & ~F.col("name").isin(*BOILERPLATE)).withColumn("local", label)
    if path is not None:
        local = local.where(F.col("path") == path)
    named = local.join(index, F.col("name") == F.col("lib_name")).withColumn("match", F.lit("name")).withColumn("similarity", F.lit(1.0))
    rest = local.join(named.select("local").distinct(), "local", "left_anti").where("size(tag) > 0")
    # Tags that are similar at all share a token; the ratio of lengths is a gate of its own.
    tokens = lambda df, c, k: df.select(k, F.explode(F.array_distinct(c)).alias("token"))
    met = tokens(rest, "tag", "local").join(tokens(index, "lib_tag", "lib"), "token").select("local", "lib").distinct()
    near = rest.join(met, "local").join(index, "lib").where("least(size(tag), size(lib_tag)) >= 0.4D * greatest(size(tag), size(lib_tag))")
    near = near.withColumn("match", F.lit("doc")).withColumn("similarity", _tag_similarity(F.col("tag"), F.col("lib_tag"))).where(F.col("similarity") >= doc_threshold)
    return local, named.unionByName(near.select(named.columns)).withColumn("signature_match", F.expr("sig_shape = lib_shape"))


def overlaps(symbols: DataFrame, doc_threshold: float = 0.6, suppressed: DataFrame | None = None) -> DataFrame:
    """(local, lib, match, signature_match, similarity), ordered: each top-level function or direct method outside lib with the best of those in
    lib/*.py that have its name; or, only if none has, whose tag line is similar. suppressed: (local)."""
    every = _matches(symbols, doc_threshold)[1]
    best = W.partitionBy("local", "position").orderBy(F.desc("signature_match"), F.desc("similarity"), "lib_path", "lib_position")
    found = every.withColumn("_r", F.row_number().over(best)).where("_r = 1")
    if suppressed is not None:
        found = found.join(suppressed.select("local").distinct(), "local", "left_anti")
    return found.orderBy(F.desc("signature_match"), F.desc("similarity"), "path", "position").select("local", "lib", "match", "signature_match", F.round("similarity", 3).alias("similarity"))


def checklist(symbols: DataFrame, path: str, doc_threshold: float = 0.6) -> DataFrame:
    """(local, mode, matches), ordered: each function of one file with all of the library's that it may repeat: mode is name, doc or none, matches an array of (signature_match,
    similarity, lib). Those with matches come first, of them those whose first match has the same signature, then by name. A file of lib or tests, or none, has no rows."""
    local, every = _matches(symbols, doc_threshold, path)
    order = F.struct(F.col("lib_path"), F.col("lib_position"), "signature_match", F.round("similarity", 3).alias("similarity"), "lib")
    own = every.groupBy("local", "position").agg(F.first("match").alias("mode"), F.array_sort(F.collect_list(order)).alias("m"))
    told = local.select("local", "position", "qualname").join(own, ["local", "position"], "left")
    told = told.withColumn("matches", F.transform("m", lambda x: F.struct(x["signature_match"].alias("signature_match"), x["similarity"].alias("similarity"), x["lib"].alias("lib"))))
    first = F.get("matches", F.lit(0))["signature_match"]
    told = told.orderBy(F.col("mode").isNull(), F.desc_nulls_last(first), "qualname", "position")
    return told.select("local", F.coalesce("mode", F.lit("none")).alias("mode"), F.coalesce("matches", F.array()).alias("matches"))
