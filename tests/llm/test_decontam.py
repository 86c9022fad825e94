import random
import re

from tracewell.llm import decontam

DOCS = "doc_id long, text string, item_id long, words string, rid long, h0 string"


def plain_words(t):
    return re.findall(r"[^\W_]+", (t or "").lower())


def plain(docs, items):
    """(doc_id, item_id) by trying every mask at every pair of positions, and every window."""
    out = set()
    for d, t in docs:
        w = plain_words(t)
        for i, u in items:
            v = plain_words(u)
            if min(len(v), len(w)) < 5:
                continue
            masks = decontam.MASKS if len(v) >= 10 else ["1" * len(v)]
            diagonals = {
                p - q
                for m in masks
                for p in range(len(w) - len(m) + 1)
                for q in range(len(v) - len(m) + 1)
                if all(w[p + k] == v[q + k] for k, x in enumerate(m) if x == "1")
            }
            width = min(13, len(v))
            for g in diagonals:
                equal = [0 <= g + j < len(w) and w[g + j] == x for j, x in enumerate(v)]
                if any(sum(equal[s : s + width]) >= 0.8 * width for s in range(len(v) - width + 1)):
                    out.add((d, i))
    return out


def make():
    r = random.Random(11)
    vocabulary = [f"{a}{b}" for a in "bcdfglm" for b in ("a", "é", "io", "uß")]
    say = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([3, 5, 7, 9, 10, 11, 15, 20, 30, 45, 60, 30])]
    items += [(50, items[8][1].upper()), (51, None), (None, items[9][1]), (52, "")]
    docs = []
    for d in range(90):
        body = say(r.choice([0, 4, 12, 60, 200]))
        _, t = r.choice(items[:12])
        w = t.split()
        rate = r.choice([0, 0.1, 0.2, 0.4])
        w = [r.choice(vocabulary) if r.random() < rate else x for x in w]
        if r.random() < 0.3:
            w = w[len(w) // 3 :]
        at = r.randrange(len(body) + 1)
        docs.append((d, " ".join(body[:at] + w + body[at:]) if r.random() < 0.7 else ", ".join(body)))
    return docs, items


def test_against_every_position(spark, monkeypatch):
    docs, items = make()
    d = spark.createDataFrame([(*x, 7, "a", 1, "b") for x in docs], DOCS)
    b = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")
    want = plain(docs, items)
    assert len(want) > 30
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(d, b).collect()} == want
    monkeypatch.setattr(decontam, "BLOCK", 16)
    monkeypatch.setattr(decontam, "BROADCAST_SEEDS", 0)
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    rows = decontam.contaminated(d, b).collect()
    assert {(x.doc_id, x.item_id) for x in rows} == want and len(rows) == len(want)
    kept = decontam.clean(d, b)
    assert kept.columns == d.columns
    assert {x.doc_id for x in kept.collect()} == {x for x, _ in docs} - {x for x, _ in want}


def test_edge_cases(spark):
    b = spark.createDataFrame([(1, "one two three four five six"), (None, None)], "item_id long, text string")
    d = spark.createDataFrame([(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (None, "ONE two-three four; five six"), (5, "zero " * 50_000 + "one two three four five six")], "doc_id long, text string")
    got = decontam.contaminated(d, b).collect()
    assert sorted((str(x.doc_id), x.item_id, x.start) for x in got) == [("3", 1, 0), ("5", 1, 50_000), ("None", 1, 0)]
    assert decontam.contaminated(d, b.where("false")).count() == 0
    assert decontam.contaminated(d.where("false"), b).count() == 0
    assert decontam.clean(d, b.where("false")).count() == 6


def test_masks_leave_no_placement():
    from itertools import combinations

    for n in range(5, 14):
        masks = decontam.COVER if n >= 10 else decontam.SHORT
        for other in combinations(range(n), 2 if n >= 10 else 1):
            fits = lambda m: any(all(m[i - o] == "0" for i in other if o <= i < o + len(m)) for o in range(n - len(m) + 1))
            assert any(map(fits, masks)), (n, other)


def test_every_overlap_on_every_diagonal(spark):
    """Without seeds: each item along each document."""
    docs, items = make()
    r = random.Random(2)
    for n in range(5, 14):
        items.append((100 + n, " ".join(f"i{n}x{k}" for k in range(n))))
        for k in range(4):
            w = items[-1][1].split()
            for at in r.sample(range(n), 2 if n >= 10 else 1):
                w[at] = "other"
            docs.append((1000 + 10 * n + k, "so " * k + " ".join(w)))
    want = set()
    for d, t in docs:
        w = plain_words(t)
        for i, u in items:
            v = plain_words(u)
            width = min(13, len(v))
            for g in range(-len(v), len(w)) if min(len(v), len(w)) >= 5 else ():
                equal = [0 <= g + j < len(w) and w[g + j] == x for j, x in enumerate(v)]
                if any(5 * sum(equal[s : s + width]) >= 4 * width for s in range(len(v) - width + 1)):
                    want.add((d, i))
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = lambda **k: {(x.doc_id, x.item_id) for x in decontam.contaminated(*tables, **k).collect()}
    assert found(every=True) == want
    assert len(want) - len(found()) > 10
