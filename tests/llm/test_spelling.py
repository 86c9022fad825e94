import random
import re
import zlib
from collections import Counter

import duckdb

from tracewell.llm import spelling
from tracewell.llm.queries import QUERIES
from tracewell.llm.spelling import keyed, near_words, variants

SCHEMA = "doc_id long, text string, word string, n int, key string, form string"


def plain(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def corpus():
    r = random.Random(4)
    letters, out = "abcdeéÿ×", []
    base = ["".join(r.choice(letters) for _ in range(r.randrange(6, 12))) for _ in range(40)]
    for b in list(base):
        for _ in range(4):
            at = r.randrange(len(b) + 1)
            base.append(b[:at] + r.choice(["", r.choice(letters)]) + b[at + r.choice([0, 1]) :])
    weights = [r.choice([1, 1, 5, 30, 200]) for _ in base]
    for i in range(300):
        words = r.choices(base, weights, k=60)
        out.append((i if i % 7 else None, " ".join(w.upper() if r.random() < 0.2 else w for w in words).replace("  ", "-")))
    chain = ["lantern", "lanterns", "lantersns", "lantersnss"]
    out += [(1000 + i, " ".join([chain[0]] * 8 + [chain[1]] * (i % 2) * 3 + [chain[2]] * (i % 40 == 0) * 7 + ["K" + "elvinx", "straße", "ÉCOLES"])) for i in range(200)]
    return out + [(5, None), (6, ""), (7, "12 !? ab"), (1001, out[3][1]), (1001, out[3][1])]


def test_against_every_pair(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "w", 1, "k", "f") for i, t in rows], SCHEMA).repartition(3)
    got = sorted(map(tuple, variants(docs).collect()))
    assert got == plain(rows)
    assert any(f and r != f for _, f, r, *_ in got) and sum(x[4] > 1 for x in got) > 10


def test_counts_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    rows = corpus()[:40]
    docs = spark.createDataFrame([(i, t, "w", 1, "k", "f") for i, t in rows], SCHEMA).repartition(2)
    assert sorted(map(tuple, variants(docs).collect())) == plain(rows)


def test_anagrams_meet_only_with_half_their_letters_in_place(spark):
    """Every order of seven letters: all have one anagram key, and each word meets few of the 5,040."""
    from itertools import permutations

    words = spark.createDataFrame([("".join(p), 5) for p in permutations("abcdefg")], "word string, n long")
    keys = keyed(words)
    assert keys.groupBy("key", "side", "part").count().agg({"count": "max"}).first()[0] <= 24
    assert near_words(words).count() == 0


def test_very_long_words(spark):
    word = "ÿ" * 50_000
    docs = spark.createDataFrame([(1, " ".join([word] * 6 + [word + "a"] * 40))], "doc_id long, text string")
    assert sorted((len(r.word), len(r.root), r.n, r.n_near) for r in variants(docs).collect()) == [(50_000, 50_001, 6, 1), (50_001, 50_001, 40, 1)]


def test_differ_by_one():
    words = ["", "a", "b", "ab", "ba", "aab", "aba", "abab", "abcd", "abxd", "abd", "xbcd", "abcdé", "ébcd"]
    for a in words:
        for b in words:
            assert spelling.differ_by_one(a, b) == (a != b and one_edit(a, b))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert variants(docs).collect() == []


def test_query_against_sql(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    got = sorted((tuple(r[c] for c in columns) for r in QUERIES["op12_spelling_variants"](spark, d).collect()), key=str)
    assert got == sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({spelling.SQL})").fetchall(), key=str)
