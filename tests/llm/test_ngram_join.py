import random

import pytest

from tracewell.llm import ngram_join
from tracewell.llm.ngram_join import join_components, pairs

SCHEMA = "doc_id long, text string, lang string, id long, key string, n int, rid string"


def plain_set(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return frozenset(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def alike(a, b):
    return bool(a and b) and 100 * len(a & b) >= 90 * len(a | b)


def plain(rows):
    sets, root = [plain_set(r[1]) for r in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if alike(a, sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    return sorted(((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows)), key=str)


def texts():
    r = random.Random(1)
    words, out = [f"w{i}" for i in range(60)], [None, "", " \t\n", "one", "ONE", "one two", "One  two", "É ones", "é ones", "a a a a a a", "a a a"]
    for size in (12, 30, 31, 60, 120, 300, 1000):
        base = [r.choice(words) for _ in range(size)]
        out.append(" ".join(base))
        for k in (0, 0, 1, 1, 2, size // 60, size // 40, size // 30):
            b = list(base)
            for _ in range(k):
                at = r.randrange(len(b))
                b[at : at + r.choice([0, 1, 1])] = [r.choice(words)] if r.random() < 0.8 else []
            out.append(" ".join(b) if r.random() < 0.7 else "\n".join(b).upper())
        out.append(" ".join(base[: -max(1, size // 25)]))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "k", 1, "r") for i, t in rows], SCHEMA).repartition(3)


def test_against_all_pairs(spark):
    rows = list(enumerate(texts())) + [(7, "w1 w2 w3 other words"), (None, "nobody's own text here"), (None, texts()[12]), (None, ""), (3, None)]
    docs = frame(spark, rows)
    want = plain(rows)
    assert sorted(map(tuple, join_components(docs).collect()), key=str) == want
    assert 15 < sum(c != d for d, _, c in want if d is not None) < len(rows) - 20


def test_every_pair_of_different_sets(spark):
    rows = list(enumerate(texts()))
    links, member = (x.collect() for x in pairs(frame(spark, rows)))
    sets = {m.set: plain_set(rows[m.doc_id][1]) for m in member}
    assert all((m.set is None) == (not plain_set(rows[m.doc_id][1])) for m in member)
    own = {i: s for i, s in sets.items() if i is not None}
    assert len(set(own.values())) == len(own)
    want = {(a, b, len(own[a]), len(own[b]), len(own[a] & own[b])) for a in own for b in own if a < b and alike(own[a], own[b])}
    assert {tuple(x) for x in links} == want and len(links) == len(want) > 20


def test_one_group_of_near_copies_in_linear_rows(spark, monkeypatch):
    """A passage that half of all documents begin with, and a group of near copies: the pairs that are verified follow its size."""
    r = random.Random(2)
    passage, base = [f"p{i}" for i in range(60)], [f"b{i}" for i in range(400)]
    rows = []
    for i in range(300):
        b = list(base)
        b[r.randrange(400)] = f"x{i}"
        rows.append((3 * i, " ".join(b)))
        rows.append((3 * i + 1, " ".join(passage + [f"y{i}.{j}" for j in range(r.randrange(8))])))
        rows.append((3 * i + 2, " ".join(base)))
    seen, real = [], ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda p, *x: (seen.append(p.count()), real(p, *x))[1])
    assert sorted(map(tuple, join_components(frame(spark, rows)).collect()), key=str) == plain(rows)
    assert seen[0] + seen[1] < len(rows) ** 2 / 100


@pytest.mark.parametrize("text", ["word " * 200_000, "x" * 300_000])
def test_long_texts(spark, text):
    got = join_components(frame(spark, [(2, text), (1, text + " "), (3, "else")])).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1), (2, 1, 1), (3, 1, 3)]


def test_empty(spark):
    docs = frame(spark, [(1, "a")]).where("false")
    assert join_components(docs).count() == 0
    assert join_components(frame(spark, [(1, None), (2, "")])).orderBy("doc_id").collect() == [(1, 0, 1), (2, 0, 2)]
