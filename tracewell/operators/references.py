"""Who refers to whom: missing references, ancestors, first of each, groups of one name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unreferenced(items: DataFrame, references: DataFrame, item: str, reference: str) -> DataFrame:
    return items.join(references.select(F.col(reference).alias(item)).distinct(), item, "left_anti")


def ancestors(name: Column, separator: str) -> Column:
    """Of a.b.c: a, a.b and a.b.c."""
    parts = F.split(name, F.concat(F.lit("\\Q"), F.lit(separator), F.lit("\\E")))
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))


def prefix_references(imports: DataFrame, modules: DataFrame, imported: str, module: str, separator: str = ".") -> DataFrame:
    """Imports joined to every module that they name or lie under: ancestors are exploded, then an equi-join."""
    wide = imports.withColumn("_module", F.explode(ancestors(F.col(imported), separator)))
    return wide.join(modules, wide["_module"] == modules[module]).drop("_module")


def first_of_each(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_row", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where("_row = 1").drop("_row")


def first_references(references: DataFrame, by: list[str], order: list[str], first: int) -> DataFrame:
    """by, n and refs: how many different references each has, and the first of them in order, as an array of structs of order. A reference that stands
    several times is one; nulls in order come first. Ranks are cut before the shuffle too, so a target that a third of all rows refer to sends few of them."""
    own = references.select(*by, *order).distinct()
    few = own.withColumn("_row", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_row") <= first)
    lists = few.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_row", *order))).alias("refs"))
    lists = lists.withColumn("refs", F.transform("refs", lambda r: F.struct(*[r[c].alias(c) for c in order])))
    same = lists.alias("l").join(own.groupBy(*by).agg(F.count("*").alias("n")).alias("c"), [F.col(f"l.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by])
    return same.select(*[F.col(f"l.{c}").alias(c) for c in by], "n", "refs")


def same_name_groups(items: DataFrame, name: str, group: str, least: int = 2) -> DataFrame:
    """Names that stand in several groups: (name, n_groups, n)."""
    return items.groupBy(F.col(name).alias("name")).agg(F.count_distinct(group).alias("n_groups"), F.count("*").alias("n")).where(F.col("n_groups") >= least)


def usage_counts(texts: DataFrame, tokens: Column, names: DataFrame) -> DataFrame:
    """(name, n): how often each name stands among the tokens; 0 included. names: name."""
    found = texts.select(F.explode(tokens).alias("name")).join(names.select("name").distinct(), "name", "left_semi").groupBy("name").agg(F.count("*").alias("n"))
    return names.select("name").distinct().join(found, "name", "left").select("name", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def covered_by(helpers: DataFrame, texts: DataFrame, helper: str, text: str, grams: str, least: float) -> DataFrame:
    """(helper, text, n_shared, coverage): texts that hold at least a share of a helper's distinct grams."""
    own = helpers.select(F.col(helper).alias("helper"), F.array_distinct(grams).alias("g"))
    own = own.select("helper", F.size("g").alias("n"), F.explode("g").alias("gram"))
    seen = texts.select(F.col(text).alias("text"), F.explode(grams).alias("gram"))
    met = seen.join(own, "gram").groupBy("helper", "n", "text").agg(F.count_distinct("gram").alias("n_shared"))
    return met.withColumn("coverage", F.round(F.col("n_shared") / F.col("n"), 6)).where(F.col("n_shared") >= F.col("n") * least).drop("n")
