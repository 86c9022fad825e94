"""Written intermediate tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class _Scopes(threading.local):
    """The tables of the scopes that a thread has open, innermost last; those written outside of any scope stay."""

    def __init__(self) -> None:
        self.open: list[list[tuple[SparkSession, str]]] = []


_scopes = _Scopes()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(df: DataFrame) -> int:
    """Tasks for work that is heavy for each row: as many as a shuffle has, or as there are cores."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame) -> DataFrame:
    """df, a scan, dealt out evenly if its files come to fewer tasks than there are cores, as one file without parts to split does; else as it is. For what takes long for each row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.rdd().getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees. Where the session names none a temporary one is made, if the master is local; on a cluster
    each machine would write to its own, so it has to be named."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when it is written; else they stay until the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def stash(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and survives the loss of executors. The table goes with the
    innermost scratch(), or with keep with the one around it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stash/{uuid.uuid4().hex}"
    with _shuffles_go(spark):
        df.write.parquet(f"{path}/{label}")
    if len(_scopes.open) > keep:
        _scopes.open[-1 - keep].append((spark, path))
    return spark.read.schema(df.schema).parquet(f"{path}/{label}")


def discard(*tables: DataFrame) -> None:
    """Delete stashed tables that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/stash/")[0] + "/stash/" + f.rpartition("/stash/")[2].split("/")[0] for f in df.inputFiles() if "/stash/" in f}:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that are stashed inside are deleted at the end, but for those with keep. What leaves the block must not read them."""
    _scopes.open.append([])
    try:
        yield
    finally:
        for spark, path in _scopes.open.pop():
            _delete(spark, path)


def shuffled(df: DataFrame) -> DataFrame:
    """df, for a join that broadcasts neither side. Spark goes by the bytes of files, and takes an explode for no more rows than it was given: so it would send millions of rows to the driver."""
    return df.hint("merge")


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """df, a written table, to be broadcast if it has no more rows than given; else the join shuffles."""
    return F.broadcast(df) if df.count() <= rows else shuffled(df)
