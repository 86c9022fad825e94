"""Prose metrics against their SQL, where a last bit decides."""

from itertools import product

import duckdb

from tracewell.plans.queries import ORACLE_SQL, QUERIES


def test_a_burstiness_of_just_two_fifths(spark, tmp_path):
    sizes = [xs for n, top in ((4, 24), (5, 14)) for xs in product(range(1, top), repeat=n) if 25 * n * sum(x * x for x in xs) == 29 * sum(xs) ** 2]
    rows = [(i, " ".join("A" + " b" * (x - 1) + "." for x in xs)) for i, xs in enumerate(sizes)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = QUERIES["style_sentence_stats"](spark, str(tmp_path)).select("key", "flagged").collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL["style_sentence_stats"]).project("key, flagged").fetchall()
    assert len(want) > 100 and sorted(map(tuple, got)) == sorted(want)
