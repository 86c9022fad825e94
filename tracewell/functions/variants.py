"""JSON of any shape and depth as rows, by Spark's VARIANT."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stash

#: Levels at most: JSON that nests deeper than a parser allows isn't JSON.
DEEPEST = 1000


def leaves(rows: DataFrame, json: Column | str) -> DataFrame:
    """rows' columns with path (array of keys and, in brackets, places), key (the last key above the value; null at the root), kind (string, number, boolean or null; empty for an object or
    array without members) and value, a row for each value of the JSON that isn't an object or an array with members. Text that isn't JSON has none.

    Each round opens one level; objects and arrays that are left are written and opened in the next."""
    columns = rows.columns
    none = F.array().cast("array<string>")
    open_ = rows.withColumn("_v", F.try_parse_json(json)).where("_v IS NOT NULL").select(*columns, none.alias("path"), F.lit(None).cast("string").alias("key"), "_v")
    out = None
    for _ in range(DEEPEST):
        shape = F.schema_of_variant("_v")
        nested = shape.startswith("OBJECT") | shape.startswith("ARRAY")
        size = F.expr("coalesce(size(try_cast(_v AS map<string,variant>)), size(try_cast(_v AS array<variant>)))")
        marked = open_.withColumn("_shape", shape).withColumn("_n", F.when(nested, size).otherwise(0))
        kind = F.when(nested, "empty").when(shape == "STRING", "string").when(shape == "BOOLEAN", "boolean").when(shape == "VOID", "null").otherwise("number")
        value = F.when(shape == "STRING", F.expr("try_cast(_v AS string)")).when(~nested & (shape != "VOID"), F.to_json("_v"))
        flat = marked.where("_n = 0").select(*columns, "path", "key", kind.alias("kind"), value.alias("value"))
        out = flat if out is None else out.unionByName(flat)
        held = marked.where("_n > 0")
        # An object's members by name, an array's by place.
        members = F.when(F.col("_shape").startswith("OBJECT"), F.expr("transform(map_entries(try_cast(_v AS map<string,variant>)), e -> struct(e.key AS name, e.key AS own, e.value AS v))")).otherwise(
            F.expr("transform(try_cast(_v AS array<variant>), (e, i) -> struct(concat('[', i, ']') AS name, CAST(NULL AS string) AS own, e AS v))")
        )
        each = held.select(*columns, "path", "key", F.explode(members).alias("m"))
        open_ = stash(each.select(*columns, F.concat("path", F.array("m.name")).alias("path"), F.coalesce("m.own", "key").alias("key"), F.col("m.v").alias("_v")), "level")
        if open_.isEmpty():
            return out
    raise ValueError(f"JSON of over {DEEPEST} levels")


def pointer(path: Column | str) -> Column:
    """A path as one text, places left out: a.b[].c"""
    return F.regexp_replace(F.regexp_replace(F.array_join(path, "."), r"\.?\[[0-9]+\]", "[]"), r"^\.", "")


def counts_by_path(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., pointer, kind, n, distinct) of leaves: how many values, and different ones, stand at each path."""
    return found.groupBy(*(by or []), pointer("path").alias("pointer"), "kind").agg(F.count("*").alias("n"), F.count_distinct("value").alias("distinct"))
