import math
import random

import duckdb
import numpy as np
import pytest

from tracewell.llm import hard_negatives
from tracewell.llm.hard_negatives import mine, search_block
from tracewell.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>, label int, id long, v string, cell string, score int"


def ints(v):
    return [math.floor(256 * x) if abs(x) < 2**50 else int(x) * 256 for x in v]


def plain(rows, anchors, positives=5, negatives=10, like=(30, 90)):
    own = {}
    for i, v, label in rows:
        if i is not None and label is not None and v and all(x is not None and math.isfinite(x) for x in v):
            own[i] = min(own.get(i, (label, v)), (label, v))
    told = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for a in anchors:
        if a not in own:
            continue
        label, q = own[a][0], ints(own[a][1])
        scores = sorted((-sum(x * y for x, y in zip(q, ints(v))), i) for i, (_, v) in own.items() if i != a and len(v) == len(q))
        for p, pid in [(-s, i) for s, i in scores if own[i][0] == label][:positives]:
            fits = [(-s, i) for s, i in scores if own[i][0] != label and like[0] * p <= -100 * s <= like[1] * p][:negatives]
            out += [(a, pid, r, i, told(p), told(s)) for r, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "v", "c", 2) for i, v, label in rows], SCHEMA).repartition(3)


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "block_rows", lambda width: 70)
    monkeypatch.setattr(hard_negatives, "BLOCK", 70)
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    monkeypatch.setattr(hard_negatives, "ASKS", 20)
    monkeypatch.setattr(hard_negatives, "STEP", 1)
    r = random.Random(1)
    centres = [[r.gauss(0, 1) for _ in range(5)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in centres[i % 6]], r.choice([i % 6, i % 6, 3])) for i in range(500)]
    rows += [(1000 + i, rows[7][1], 1 + i % 2) for i in range(150)]  # one vector, many times
    rows += [(2000, None, 1), (2010, [], 1), (2020, [1.0, None, 1.0, 1.0, 1.0], 1), (2030, [float("nan")] * 5, 1), (2040, [float("inf")] * 5, 1), (2050, [1.0] * 5, None)]
    rows += [(None, [1.0] * 5, 1), (2060, [1.0, 2.0], 1), (2070, [2.0, 2.0], 1), (2080, [0.9, 0.9], 2), (20, [0.5] * 5, 0), (20, rows[20][1], 0), (2090, [0.0] * 5, 1), (-20, [1.0] * 5, 2)]
    want = plain(rows, [i for i in {x[0] for x in rows} if i is not None and i % 20 == 0])
    got = sorted(map(tuple, mine(frame(spark, rows), "id % 20 = 0").collect()))
    assert got == want and len(want) > 500


def test_large_components_take_part(spark):
    r = random.Random(2)
    rows = [(i, [r.gauss(0, 1) * r.choice([1, 1e3, 1e20, 3e38]) for _ in range(2)], i % 2) for i in range(80)]
    want = plain(rows, range(0, 80, 10), 3, 4)
    assert sorted(map(tuple, mine(frame(spark, rows), "id % 10 = 0", 3, 4).collect())) == want and want


def test_annulus_leaves_rows_out(monkeypatch):
    """Near rows are found, and windows kept, without scoring most of the others."""
    monkeypatch.setattr(hard_negatives, "LEAF", 16)
    monkeypatch.setattr(hard_negatives, "STEP", 1)
    r = np.random.default_rng(3)
    centres = r.normal(size=(40, 8)) * 40_000
    x = np.concatenate([c + r.normal(size=(50, 8)) * 50 for c in centres]).astype(np.int64)
    ids, labels, norm = np.arange(len(x)), np.arange(len(x)) % 3, int((x * x).sum(axis=1).max())
    asks, want = [], []
    for q in range(0, 2000, 40):
        s = x @ x[q]
        own = np.sort(s[(labels == labels[q]) & (ids != q)])[-1]
        low, high = hard_negatives.window(int(own), (30, 90))
        asks.append((q, labels[q], low, high))
        fits = np.flatnonzero((labels != labels[q]) & (s >= low) & (s <= high))
        want.append(fits[np.lexsort((fits, -s[fits]))][:10].tolist())
    done = 0
    for w, (found, _scores, n) in zip(want, search_block(asks, x[::40], ids, labels, x, norm, 10, False), strict=True):
        assert found.tolist() == w
        done += n
    assert done < 0.5 * len(asks) * len(x)


@pytest.mark.parametrize("p", [-7, -1, 0, 1, 9, 10, 11, 12345])
def test_window(p):
    low, high = hard_negatives.window(p, (30, 90))
    assert [n for n in range(-20, 20_000) if 30 * p <= 100 * n <= 90 * p] == list(range(max(low, -20), high + 1))


def test_empty(spark):
    assert mine(frame(spark, [(0, [1.0], 1)]).where("false"), "id % 10 = 0").collect() == []
    assert mine(frame(spark, [(0, [1.0], 1), (1, [1.0], 2)]), "id % 10 = 0").collect() == []


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    assert sorted(map(tuple, QUERIES["op13_hard_negatives"](spark, d).collect())) == sorted(con.execute(hard_negatives.SQL).fetchall())
