import duckdb
import numpy as np

from tracewell.llm import pivot_topk
from tracewell.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, v string, id string, part int"


def plain(rows, queries, k):
    out = []
    ints = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v):
            ints.setdefault(i, []).append([int(np.floor(256 * float(np.float32(x)))) for x in v])
    for q in queries:
        best = {}
        for a in ints.get(q, []):
            for i, own in ints.items():
                for b in own:
                    if i != q and len(a) == len(b):
                        best[i] = max(best.get(i, -(2**62)), sum(x * y for x, y in zip(a, b)))
        out += [(q, r, i, s) for r, (i, s) in enumerate(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:k], 1)]
    return sorted(out)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(pivot_topk, "BLOCK", 60)
    monkeypatch.setattr(pivot_topk, "QUERIES", 5)
    monkeypatch.setattr(pivot_topk, "STEP", 4)
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=6) * r.choice([0.01, 1, 30])]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)]
    rows += [(400, None), (410, []), (420, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (430, [1.0, float("nan"), 1.0, 1.0, 1.0, 1.0]), (440, [float("inf")] * 6), (None, [1.0] * 6), (450, [1.0, 2.0]), (460, [2.0, 2.0]), (10, [0.5] * 6), (10, rows[10][1]), (470, [0.0] * 6)]
    v = spark.createDataFrame([(*x, "a", "b", 1) for x in rows], SCHEMA).repartition(3)
    got = pivot_topk.top_k(v, v.where("vec_id % 10 = 0"), 5)
    want = plain(rows, sorted({i for i, _ in rows if i is not None and i % 10 == 0}), 5)
    assert sorted(map(tuple, got.collect())) == want
    assert pivot_topk.top_k(v.where("false"), v).count() == 0
    assert pivot_topk.top_k(v, v.where("false")).count() == 0


def test_bounds_leave_candidates_out():
    """Near vectors are found without looking at all the others."""
    r = np.random.default_rng(1)
    centres = r.normal(size=(40, 8)) * 40_000
    x = np.concatenate([c + r.normal(size=(50, 8)) * 50 for c in centres]).astype(np.int64)
    x = (x / np.sqrt((x * x).sum(axis=1, keepdims=True)) * 100_000).astype(np.int64)
    ids = np.arange(len(x))
    done = 0
    for q, found, scores, n in pivot_topk.search_block(ids[:50], x[:50], ids, x, x[::63], 5):
        every = x @ x[q]
        every[q] = -(2**62)
        best = np.lexsort((ids, -every))[:5]
        assert found.tolist() == best.tolist() and scores.tolist() == every[best].tolist()
        done += n
    assert done < 0.5 * 50 * len(x)


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    assert sorted(map(tuple, QUERIES["op2_exact_topk"](spark, d).collect())) == sorted(con.execute(pivot_topk.SQL).fetchall())


def test_large_components_take_part(spark):
    """Finite vectors of any size, by exact integers: scores beyond a long are ranked as they are and told as the nearest long."""
    rows = [(0, [1.0, 2.0]), (50, [3e38, -3e38]), (1, [3e38, 1.0]), (2, [2.9e38, 1.0]), (3, [-3e38, 3e38]), (4, [-2.9e38, 3e38]), (5, [0.5, 0.5]), (6, [2.0**40, 2.0**40]), (7, [1e9, -1e9]), (8, [float("inf"), 1.0])]
    exact = {i: [int(np.floor(256 * float(np.float32(x)))) if abs(x) < 2**50 else int(float(np.float32(x))) * 256 for x in v] for i, v in rows if np.isfinite(v).all()}
    v = spark.createDataFrame([(*x, "a", "b", 1) for x in rows], SCHEMA)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in pivot_topk.top_k(v, v.where("vec_id % 50 = 0"), 8).collect()}
    for q in (0, 50):
        best = sorted(((-sum(a * b for a, b in zip(exact[q], x)), i) for i, x in exact.items() if i != q))[:8]
        assert [got[q, r] for r in range(1, len(best) + 1)] == [(i, max(-(2**63), min(2**63 - 1, -s))) for s, i in best]
