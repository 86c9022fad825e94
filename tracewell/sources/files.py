"""Files of a project as rows."""

from __future__ import annotations

import os
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that no scan enters, and the endings of documents.
EXCLUDED = (
    ".git", ".hg", ".mypy_cache", ".nox", ".pytest_cache", ".ruff_cache", ".svn", ".tox", ".venv",
    "__pycache__", "build", "dist", "env", "frozen_source", "node_modules", "reports", "site-packages", "venv",
)
DOCUMENTS = (".md", ".txt", ".tex", ".bat", ".sh", ".toml", ".yml", ".yaml", ".ps1", ".cfg", ".ini")


def scan(spark: SparkSession, root: str, endings: tuple[str, ...] = (".py",), subdirs: tuple[str, ...] = (), excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(path, content): files under root, whose path is relative to it, of these endings; no part of a path may be excluded. subdirs limits the
    first part; a file that two of them cover comes once. Unreadable bytes stay as they are: content is binary.

    Spark's own readers hide names that begin with an underscore, such as __init__.py, and empty files. So a folder that executors share is listed
    by the driver (names only) and read by the tasks; other stores go through Spark's reader, without those files."""
    if "://" in root and not root.startswith("file://"):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
        rows = found.select(F.expr(f"substring_index(path, '{root.rstrip('/').split('://', 1)[1]}/', -1)").alias("path"), "content")
    else:
        rows = _shared(spark, root.removeprefix("file://").rstrip("/"), endings, excluded)
    parts = F.split("path", "/")
    rows = rows.where(F.lower(F.regexp_extract("path", "(\\.[^./]*)$", 1)).isin(*endings)).where(~F.arrays_overlap(parts, F.array(*map(F.lit, excluded))))
    if subdirs and "." not in subdirs:
        rows = rows.where(F.array_contains(F.array(*map(F.lit, subdirs)), F.get(parts, F.lit(0))))
    return rows


def _shared(spark: SparkSession, root: str, endings: tuple[str, ...], excluded: tuple[str, ...]) -> DataFrame:
    names = []
    for folder, inside, own in os.walk(root):
        inside[:] = [d for d in inside if d not in excluded]
        names += [(os.path.relpath(os.path.join(folder, n), root).replace(os.sep, "/"),) for n in own if n.lower().endswith(endings)]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(content=[Path(root, p).read_bytes() for p in b["path"]])

    tasks = max(1, min(len(names) // 64, 4096))
    return spark.createDataFrame(sorted(names), "path string").repartition(tasks, "path").mapInPandas(read, "path string, content binary")


def texts(files: DataFrame) -> DataFrame:
    """(path, text): decoded as UTF-8, a byte order mark left out, bad bytes replaced."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda b: bytes(b).decode("utf-8-sig", "replace"))

    return files.select("path", decoded("content").alias("text"))


def module_name(path: str = "path") -> F.Column:
    """The dotted name of a file; __init__ is left out."""
    return F.regexp_replace(F.replace(F.regexp_replace(path, "\\.py$", ""), F.lit("/"), F.lit(".")), "(^|\\.)__init__$", "")
