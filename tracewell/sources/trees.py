"""Digests of trees of files: of each file, of each folder from its members, and so of the root.

A folder's digest is the SHA-256 of its members' names and digests in the order of names. So two states of a tree are compared from the root down, and only folders whose digests differ are looked
into; and what was made of a file can be used again while its digest stays. A folder holds the digests of its direct members together, a line for each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.tables import stash

#: The kinds of files that an audit reads, in the order in which a basis names them.
SCOPES = ("source", "documents", "tex")


def file_digests(files: DataFrame) -> DataFrame:
    """(path, digest, size) of files (path, content)."""
    return files.select("path", F.sha2("content", 256).alias("digest"), F.length("content").cast("bigint").alias("size"))


def tree(digests: DataFrame) -> DataFrame:
    """(path, parent, depth, folder, digest, files, size), a written table: the files and every folder above them; the root's path is empty and its parent null. An empty tree has no root.
    Each level is made of the one below, so there are as many steps as the deepest path has parts."""
    up = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise("")
    level = digests.select("path", up.alias("parent"), F.size(F.split("path", "/")).alias("depth"), F.lit(False).alias("folder"), "digest", F.lit(1).cast("bigint").alias("files"), "size")
    level = stash(level, "files")
    out, depth = level, level.agg(F.max("depth")).first()[0] or 0
    while depth:
        own = out.where(F.col("depth") == depth)
        name = F.regexp_extract("path", "([^/]*)$", 1)
        # A folder and a file of one name can't meet, but a line tells them apart.
        line = F.concat(name, F.lit("\0"), F.col("folder").cast("string"), F.lit("\0"), "digest")
        made = own.groupBy("parent").agg(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256).alias("digest"), F.sum("files").alias("files"), F.sum("size").alias("size"))
        depth -= 1
        above = F.when(F.col("parent") == "", F.lit(None)).when(F.col("parent").contains("/"), F.regexp_extract("parent", "^(.*)/[^/]*$", 1)).otherwise("")
        made = made.select(F.col("parent").alias("path"), above.alias("parent"), F.lit(depth).alias("depth"), F.lit(True).alias("folder"), "digest", "files", "size")
        out = out.unionByName(stash(made, "folders"))
    return out


def changes(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, change): files that are new, gone or changed between two trees. From the root down: the members of a folder are compared only if the folder's digests differ, or one side lacks it."""
    found, at = None, None
    deepest = max(before.agg(F.max("depth")).first()[0] or 0, now.agg(F.max("depth")).first()[0] or 0)
    for depth in range(deepest + 1):
        a = before.where(F.col("depth") == depth).select("path", "folder", F.col("digest").alias("was"), F.col("parent"))
        b = now.where(F.col("depth") == depth).select("path", "folder", F.col("digest").alias("is"), F.col("parent"))
        if at is not None:
            a, b = (x.join(at, x["parent"] == at["open"], "left_semi") for x in (a, b))
        met = a.drop("parent").join(b.drop("parent"), ["path", "folder"], "full").where("NOT was <=> is")
        met = stash(met.withColumn("change", F.when(F.col("was").isNull(), "new").when(F.col("is").isNull(), "gone").otherwise("changed")), "differ")
        files = met.where("NOT folder").select("path", "change")
        found = files if found is None else found.unionByName(files)
        at = met.where("folder").select(F.col("path").alias("open")).distinct()
        if at.isEmpty():
            break
    return found if found is not None else before.select("path", F.lit("").alias("change")).where("false")


def renewed(files: DataFrame, digests: DataFrame, before: DataFrame, made: DataFrame, parse: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What parse makes of files, where only files whose digest no earlier file of their path had are parsed. digests: (path, digest) of files; before: the same of the earlier state;
    made: parse's rows of that, which have a path."""
    same = stash(digests.select("path", "digest").join(before.select("path", "digest"), ["path", "digest"], "left_semi").select("path"), "same")
    fresh = parse(files.join(same, "path", "left_anti"))
    return made.join(same, "path", "left_semi").select(*fresh.columns).unionByName(fresh)


def basis(scopes: dict[str, DataFrame]) -> DataFrame:
    """(scope, digest, files): the root of each scope's tree, none for a scope without files. scopes: name to (path, content)."""
    out = None
    for name in SCOPES:
        if name in scopes:
            own = tree(file_digests(scopes[name])).where("depth = 0")
            one = own.select(F.lit(name).alias("scope"), "digest", "files")
            out = one if out is None else out.unionByName(one)
    return out


def mismatches(reviewed: DataFrame, live: DataFrame) -> tuple[str, ...]:
    """The scopes whose basis is another one now, as review.failures takes them: at most one for each of SCOPES. Both: as basis gives them."""
    met = reviewed.select("scope", F.col("digest").alias("was")).join(live.select("scope", F.col("digest").alias("is")), "scope", "full").where("NOT was <=> is")
    return tuple(sorted(f"{r.scope} has changed" for r in met.select("scope").collect()))
