"""The best part by name or words, among all others."""

from tracewell.plans.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_search_among_all_parts(spark):
    parts = [tuple(x) for x in spark.read.parquet(f"{SF}/part.parquet").select("p_partkey", "p_name", "p_size").collect()]
    want = {}
    for k, name, size in parts:
        if k % 100 == 0:
            own, best = set(name.split(" ")), []
            for k2, other, size2 in parts:
                words = set(other.split(" "))
                if k2 != k and own & words:
                    # A part of the same name goes before all others.
                    score = 1.0 if name == other else len(own & words) / len(own | words)
                    best.append((name != other, -score, abs(size - size2), k2))
            if best:
                far, score, _, found = min(best)
                want[k] = (found, "words" if far else "name", round(-score, 6))
    got = {x.part: (x.found, x.how, float(x.score)) for x in QUERIES["capability_search"](spark, SF).collect()}
    assert got == want
    old = {x.part: x.found for x in QUERIES["capability_name_then_doc"](spark, SF).collect()}
    print("other best:", sum(old.get(k) != found for k, (found, _, _) in got.items()), "of", len(got))
    assert any(old.get(k) != found for k, (found, _, _) in got.items())


def test_rows_come_from_names_and_sizes(spark, tmp_path, monkeypatch):
    from tracewell.operators import references

    n = 4000
    spark.range(n).selectExpr("id AS p_partkey", "IF(id = 300, 'only one', concat(IF(id % 2 = 0, 'red', 'blue'), ' ring')) AS p_name", "CAST(id % 5 AS INT) AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    met, first = [], references.first_of_each
    monkeypatch.setattr(references, "first_of_each", lambda rows, *a: (met.append(rows.count()), first(rows, *a))[1])
    got = {x.part: (x.found, x.how) for x in QUERIES["capability_search"](spark, str(tmp_path)).collect()}
    # The smallest of the same name and size, or the next where that is the part itself.
    assert got == {k: (10 if k == 0 else 0, "name") for k in range(0, n, 100) if k != 300} and met[0] <= 5 * n / 100
