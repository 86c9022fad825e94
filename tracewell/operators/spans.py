"""Islands and contained spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def islands(rows: DataFrame, by: str, order: list[str], gap: Column) -> DataFrame:
    """With island, from 0: a new one begins where gap, a predicate that may use prev (the first order column of the row before), holds."""
    own = W.partitionBy(by).orderBy(*order)
    rows = rows.withColumn("prev", F.lag(order[0]).over(own))
    return rows.withColumn("island", F.sum(F.when(F.col("prev").isNotNull() & gap, 1).otherwise(0)).over(own)).drop("prev")


def drop_contained(spans: DataFrame, by: str, start: str, end: str, tie: str) -> DataFrame:
    """Without the spans that an earlier or larger one of the same group contains; of equal ones the first by tie stays."""
    before = W.partitionBy(by).orderBy(F.col(start), F.desc(end), F.col(tie)).rowsBetween(W.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    return spans.withColumn("_reach", reach).where(F.col("_reach").isNull() | (F.col("_reach") < F.col(end))).drop("_reach")
