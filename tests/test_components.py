"""Components by written rounds and in one task give the same."""

import random

from pyspark.sql import functions as F

from tracewell.operators.graph import components


def test_one_task_gives_what_rounds_give(spark):
    r = random.Random(1)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    rounds = sorted(map(tuple, components(df).collect()))
    assert sorted(map(tuple, components(df, few=1000).collect())) == rounds and sorted(map(tuple, components(df, few=3).collect())) == rounds
    assert components(df.where("false"), few=10).count() == 0


def test_nodes_of_any_kind(spark):
    r = random.Random(2)
    edges = spark.createDataFrame([(r.choice("abc"), r.randrange(9), r.choice("abc"), r.randrange(9)) for _ in range(14)], "p string, i int, q string, j int")
    pairs = edges.select(F.struct(F.col("p").alias("p"), F.when(F.col("i") > 0, F.col("i")).alias("i")).alias("a"), F.struct(F.col("q").alias("p"), F.when(F.col("j") > 0, F.col("j")).alias("i")).alias("b"))
    assert sorted(map(str, components(pairs, few=100).collect())) == sorted(map(str, components(pairs).collect()))
    words = edges.select(F.concat("p", "i").alias("a"), F.concat("q", "j").alias("b"))
    assert sorted(map(tuple, components(words, few=100).collect())) == sorted(map(tuple, components(words).collect()))
