import random
from collections import defaultdict

from tracewell.llm import cdc

SCHEMA = "doc_id long, text string, rid string, start int, d1 string"


def plain_cuts(data):
    """Byte by byte; a hash of 32 bits forgets all but the last bytes that its upper bits depend on."""
    out, last = [], 0
    for i in range(len(data)):
        h = 0
        for b in data[max(0, i - cdc.WINDOW + 1) : i + 1]:
            h = (2 * h + int(cdc.GEAR[b])) % 2**32
        if h >> (32 - cdc.MASK_BITS) == 0 and i + 1 - last >= cdc.MIN_BYTES or i + 1 - last == cdc.MAX_BYTES:
            out.append(i + 1)
            last = i + 1
    return out + [len(data)] * (last < len(data))


def plain_repeats(rows):
    rows = sorted(set(rows), key=str)
    places = defaultdict(set)
    own = {}
    for d in rows:
        data, start = (d[1] or "").encode(), 0
        own[d] = []
        for e in plain_cuts(data):
            own[d].append((start, e, data[start:e]))
            places[data[start:e]].add(d)
            start = e
    out = []
    for d in rows:
        run = []
        for c in [*own[d], None]:
            if c and len(places[c[2]]) > 1:
                run.append(c)
                continue
            if run and run[-1][1] - run[0][0] >= cdc.LEAST_BYTES:
                out.append((d[0], run[0][0], run[-1][1]))
            run = []
    return out


def corpus():
    r = random.Random(9)
    vocabulary = ["".join(r.choices("abcdefghijklmé", k=r.randrange(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(r.choices(vocabulary, k=n))
    passages = [say(60) for _ in range(6)]
    rows = [(i, say(r.randrange(0, 120)) + " " + (r.choice(passages) if i % 3 == 0 else say(8)) + " " + say(r.randrange(0, 90))) for i in range(60)]
    return [*rows, (100, rows[4][1]), (101, None), (102, ""), (None, rows[7][1]), (4, rows[4][1]), (103, "z" * 5000), (104, passages[0]), (104, passages[0] + " more")]


def test_cuts():
    for _, t in corpus():
        assert cdc.cuts((t or "").encode()) == plain_cuts((t or "").encode())


def test_against_plain(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*x, "a", 1, "b") for x in rows], SCHEMA).repartition(3)
    got = cdc.repeats(docs).collect()
    want = plain_repeats(rows)
    assert sorted(((x.doc_id, x.start, x.end) for x in got), key=str) == sorted(want, key=str)
    shared = {d for d, t in rows if d is not None and d < 60 and d % 3 == 0}
    assert shared <= {x.doc_id for x in got}
    by = {(x.doc_id, x.start): x for x in got}
    assert by[4, 0].keep and not by[100, 0].keep and by[100, 0].first_doc_id == 4 and not by[None, 0].keep


def test_dedup(spark):
    r = random.Random(3)
    say = lambda n: " ".join("".join(r.choices("abcdefghiéß", k=6)) for _ in range(n))
    p = say(200)
    docs = spark.createDataFrame([(1, say(30) + " " + p), (2, p + " " + say(30)), (3, say(50)), (4, None)], "doc_id long, text string")
    got = {x.doc_id: x for x in cdc.dedup(docs).collect()}
    texts = {x.doc_id: x.text for x in docs.collect()}
    assert got[1].text == texts[1] and got[3].text == texts[3] and got[4].text is None
    assert got[2].n_cut == 1 and len(got[2].text) < len(texts[2]) - 800 and got[2].text.endswith(texts[2][-60:])
    assert cdc.repeats(docs.where("false")).count() == 0 and cdc.dedup(docs.where("false")).count() == 0
