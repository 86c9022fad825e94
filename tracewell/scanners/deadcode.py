"""Modules that nothing refers to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.references import first_references
from ..sources.files import module_name
from ..plans.tables import stash
from .duplicates import imports_of

#: The ladder, first match wins.
LADDER = """CASE WHEN failed THEN 'PARSE-ERROR' WHEN is_test THEN 'TEST' WHEN is_package THEN 'PACKAGE' WHEN referred OR mentioned THEN 'USED'
  WHEN has_main THEN 'ENTRYPOINT' WHEN documented THEN 'DOC-ONLY' WHEN public THEN 'PUBLIC_API_CANDIDATE' ELSE 'DEAD' END"""
#: References of each kind that are told of a file; all are counted.
TOLD = 12
#: What may stand in a needle: module names, paths and file names are runs of these.
RUN = "[A-Za-z0-9_./-]+"


def _first(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return rows.withColumn("_r", F.row_number().over(W.partitionBy(*by).orderBy(order))).where("_r = 1").drop("_r")


def _dynamic(facts: DataFrame, files: DataFrame, package: str) -> DataFrame:
    """(path, target, mechanism, line) of imports by hint: a path from the file's folder, then from the root, then from the folder that holds the package; or a module by name, else the longest that the
    name begins with, else the first whose last part is the hint's or begins with it and an underscore."""
    hints = facts.where("kind = 'dynamic'").select("path", F.col("value").alias("hint"), F.col("detail").alias("mechanism"), "line").distinct()
    targets = files.select(F.col("path").alias("target"), "module")
    clean = F.regexp_replace("hint", "^(\\./)+", "")
    # Two folders up at most, as ../../x.py has them.
    up = lambda p: F.regexp_replace(F.regexp_replace(p, "(^|/)(?!\\.\\./)[^/]+/\\.\\./", "$1"), "(^|/)(?!\\.\\./)[^/]+/\\.\\./", "$1")
    here = up(F.concat(F.regexp_replace("path", "[^/]*$", ""), clean))
    outside = F.when(clean.startswith(f"{package}/"), F.substring(clean, F.lit(len(package) + 2), F.length(clean))) if package else F.lit(None).cast("string")
    by_path = hints.where("hint LIKE '%.py'").withColumn("way", F.explode(F.array(F.struct(F.lit(0).alias("n"), here.alias("p")), F.struct(F.lit(1).alias("n"), clean.alias("p")), F.struct(F.lit(2).alias("n"), outside.alias("p")))))
    by_path = _first(by_path.join(targets, F.col("way.p") == F.col("target")), ["path", "hint", "line"], "way.n")
    named = hints.where("NOT hint LIKE '%.py'")
    exact = named.join(targets.where("module <> ''"), F.col("hint") == F.col("module"))
    last = F.regexp_extract("hint", "([^.]*)$", 1)
    known = ["path", "hint", "line"]
    rest = named.join(exact.select(*known), known, "left_anti")
    begun = rest.withColumn("begin", F.explode(F.expr("transform(sequence(1, greatest(1, size(split(hint, '[.]')) - 1)), n -> substring_index(hint, '.', n))")))
    begun = _first(begun.join(targets.where("module <> ''"), (F.col("begin") == F.col("module")) & (F.col("begin") != F.col("hint"))).withColumn("short", -F.length("begin")), known, "short")
    rest = rest.join(begun.select(*known), known, "left_anti").withColumn("last", last)
    # The first word of a module's last part is what a nickname can be: an equi-join for whole and for begun names.
    bases = targets.where("module <> ''").withColumn("base", F.regexp_extract("module", "([^.]*)$", 1))
    starts = F.transform(F.filter(F.sequence(F.lit(1), F.length("base")), lambda i: (i == F.length("base")) | (F.substring(F.col("base"), i + 1, F.lit(1)) == "_")), lambda i: F.substring(F.col("base"), F.lit(1), i))
    near = _first(rest.join(bases.withColumn("start", F.explode(starts)), F.col("last") == F.col("start")), ["path", "hint", "line"], "target")
    columns = ["path", "target", "mechanism", "line"]
    return by_path.select(columns).unionAll(exact.select(columns)).unionAll(begun.select(columns)).unionAll(near.select(columns)).where("path <> target").distinct()


def _pinned(facts: DataFrame, files: DataFrame, package: str) -> DataFrame:
    """(path, target) of bare imports of a file that puts a folder of the package on sys.path: the first module of that name under it."""
    folders = files.select(F.explode(F.slice(F.split("path", "/"), 1, 1)).alias("folder")).where("folder NOT LIKE '%.py'").distinct().unionAll(files.limit(1).select(F.lit(package).alias("folder"))).distinct()
    pins = facts.where("kind = 'sys_path'").select("path", "value").join(F.broadcast(folders), F.expr("contains(value, folder)")).select("path", "folder").distinct()  # folders: the package's top level
    bare = facts.where("kind = 'import' AND NOT contains(value, '.')").select("path", F.col("value").alias("name")).distinct()
    tops = files.where("module <> ''").select(F.col("module").alias("name"))
    bare = bare.join(tops, "name", "left_anti").join(pins, "path")
    bases = files.where("module <> ''").select(F.col("path").alias("target"), F.regexp_extract("module", "([^.]*)$", 1).alias("name"), F.regexp_extract("module", "^([^.]*)", 1).alias("folder"))
    return _first(bare.join(bases, ["name", "folder"]).where("path <> target"), ["path", "name"], "target").select("path", "target")


def _mentions(texts: DataFrame, needles: DataFrame, own: str) -> DataFrame:
    """(target, path), distinct: files and the others, one of whose needles stands in a text of another file, between characters that no name has. needles: (target, needle)."""
    runs = texts.select("path", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(RUN), F.lit(0)))).alias("run"))
    # A needle within a longer run begins and ends where a name does: every such stretch of the run is tried that has no more parts than a needle.
    parts = "split({}, '(?<=[./-])|(?=[./-])')"
    most = needles.agg(F.max(F.expr(f"size({parts.format('needle')})"))).first()[0] or 0
    stretch = runs.withColumn("p", F.expr(parts.format("run"))).select("path", F.explode(F.expr(f"flatten(transform(sequence(1, size(p)), i -> transform(sequence(1, least({max(1, most)}, size(p) - i + 1)), n -> array_join(slice(p, i, n), ''))))")).alias("needle")).distinct()
    return stretch.join(needles.where("needle <> ''"), "needle").where(own).select("target", "path").distinct()


def _lists(references: DataFrame, order: list[str], name: str) -> DataFrame:
    """(path, name, n_name): the first TOLD references of a file, in order, and how many there are. references: target and order."""
    own = first_references(references, ["target"], order, TOLD)
    return own.select(F.col("target").alias("path"), (F.transform("refs", lambda r: r[order[0]]) if len(order) == 1 else F.col("refs")).alias(name), F.col("n").alias(f"n_{name}"))


def deadcode(facts: DataFrame, texts: DataFrame, documents: DataFrame | None = None, package: str = "", public_api: bool = False, suppressed: DataFrame | None = None) -> DataFrame:
    """(path, module, status) of every file, and what refers to it: py_refs (paths), dynamic_edges (path, mechanism, line), dynamic_refs and doc_refs (paths), the first TOLD of
    each in order, and n_ and these names, how many there are. Imports by hint are py_refs too. dynamic_refs, files whose text names it, are sought only if there are no py_refs. texts and documents: (path, text); suppressed: (path)."""
    files = facts.groupBy("path").agg(F.bool_or(F.col("kind") == "failure").alias("failed"), F.bool_or(F.col("kind") == "main_guard").alias("has_main")).withColumn("module", module_name())
    edges = stash(_dynamic(facts, files, package), "edges")
    pairs = stash(imports_of(facts).select("target", "path").unionAll(edges.select("target", "path")).unionAll(_pinned(facts, files, package).select("target", "path")).distinct(), "references")
    referred = pairs.select(F.col("target").alias("path")).distinct()
    rest = files.join(referred, "path", "left_anti").where("module <> ''")
    name = F.regexp_extract("path", "([^/]*)$", 1)
    needles = lambda df, *more: df.select(F.col("path").alias("target"), F.explode(F.array("module", "path", name, *more)).alias("needle"))
    out = files.join(_lists(pairs, ["path"], "py_refs"), "path", "left").join(_lists(edges, ["path", "mechanism", "line"], "dynamic_edges"), "path", "left")
    out = out.join(_lists(_mentions(texts, needles(rest), "path <> target"), ["path"], "dynamic_refs"), "path", "left")
    if documents is not None:
        stem = F.regexp_replace(name, "\\.py$", "")
        out = out.join(_lists(_mentions(documents, needles(files, stem), "true"), ["path"], "doc_refs"), "path", "left")
    else:
        out = out.withColumns({"doc_refs": F.array().cast("array<string>"), "n_doc_refs": F.lit(0).cast("bigint")})
    kinds = ("py_refs", "dynamic_edges", "dynamic_refs", "doc_refs")
    out = out.withColumns({f"n_{k}": F.coalesce(f"n_{k}", F.lit(0)).cast("bigint") for k in kinds} | {k: F.coalesce(k, F.array()) for k in kinds})
    out = out.withColumns({"referred": F.expr("n_py_refs > 0"), "mentioned": F.expr("n_dynamic_refs > 0"), "documented": F.expr("n_doc_refs > 0")})
    has_init = files.where("path = '__init__.py'").limit(1).select(F.lit(True).alias("has_init"))
    out = out.join(F.broadcast(has_init), how="left") if public_api else out.withColumn("has_init", F.lit(False))
    parts = F.split("path", "/")
    out = out.select(
        "path", "module", "failed", "has_main", *kinds, *[f"n_{k}" for k in kinds], *[F.coalesce(c, F.lit(False)).alias(c) for c in ("referred", "mentioned", "documented")],
        F.array_contains(parts, "tests").alias("is_test"), (name == "__init__.py").alias("is_package"),
        (F.coalesce("has_init", F.lit(False)) & F.lit(not package.startswith("_")) & (name != "__init__.py") & F.forall(parts, lambda p: ~p.startswith("_"))).alias("public"),
    )
    if suppressed is not None:
        out = out.join(suppressed.select("path").distinct(), "path", "left_anti")
    return out.select("path", "module", F.expr(LADDER).alias("status"), *kinds, *[f"n_{k}" for k in kinds])
