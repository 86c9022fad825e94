"""Paths that JSON manifests hold to a hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.variants import leaves

#: A hash, and a path to a file that has an ending.
HASH = "^[0-9a-f]{64}$"
SOURCE = r"^[^\s:*?\"<>|]+\.[A-Za-z0-9]+$"


def locked_files(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """(path, manifests array): files that exist and that a manifest locks, by a key that looks like a path to a file and has a hash as its value, at any depth.
    manifests: (path, content); files: (path)."""
    said = manifests.select(F.col("path").alias("manifest"), F.try_validate_utf8(F.col("content").cast("string")).alias("said"))
    held = leaves(said, "said").where((F.col("kind") == "string") & F.col("value").rlike(HASH) & F.col("key").rlike(SOURCE) & ~F.try_element_at("path", F.lit(-1)).startswith("["))
    found = held.select(F.regexp_replace(F.replace("key", F.lit("\\"), F.lit("/")), r"^\./", "").alias("path"), "manifest")
    return found.join(files.select("path").distinct(), "path", "left_semi").groupBy("path").agg(F.array_sort(F.collect_set("manifest")).alias("manifests"))


def for_package(locked: DataFrame, package: str) -> DataFrame:
    """The same with paths of the package relative to it."""
    inside = F.when(F.col("path").startswith(package + "/"), F.expr(f"substring(path, {len(package) + 2})")).otherwise(F.col("path"))
    return locked.withColumn("path", inside).groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("manifests")))).alias("manifests"))
