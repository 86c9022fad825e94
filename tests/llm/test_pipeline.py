"""Each stage of the pipeline against a plain version on its own input, and run() against the stages."""

import random

import corpus_pipeline
from tracewell.llm import sp_lattice

from .test_decontam import plain as plain_leaks
from .test_line_dedup import plain_dedup, plain_form
from .test_simhash_dedup import plain_components, plain_fingerprint

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make():
    r = random.Random(21)
    words = {lang: ["".join(r.choices(s, k=r.randrange(2, 4))) for _ in range(150)] for lang, s in {"aa": ["lo", "mi", "na", "te"], "bb": ["ster", "krux", "pfö", "ung"]}.items()}
    say = lambda lang, n: " ".join(r.choices(words[lang], k=n))
    items = [(i, say("aa", 20)) for i in range(4)]
    common = say("aa", 12)
    rows = []
    for i in range(36):
        lang = ("aa", "bb")[i % 2]
        lines = [say(lang, r.randrange(5, 30)) for _ in range(r.randrange(1, 5))]
        if i % 5 == 0:
            lines.append(common)
        if i % 9 == 4:
            lines.append("so " + items[i % 4][1] + " end")
        rows.append((i, "\n".join(lines), lang, "s", 0))
    base = say("bb", 300).split()
    for i in range(40, 46):
        w = list(base)
        w[i] = "anders"
        rows.append((i, "\n".join(" ".join(w[j : j + 60]) for j in range(0, 300, 60)), "bb", "s", 0))
    rows += [(50, rows[3][1], "bb", "s", 0), (51, None, "aa", None, None), (52, " 12 - ", "aa", "s", 6), (53, "", None, None, None), (54, say("aa", 30), None, "t", 1)]
    return rows, items


def test_stages(spark, tmp_path):
    rows, items = make()
    d = f"{tmp_path}/tables"
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs, before = spark.read.parquet(f"{d}/documents.parquet"), {r[0]: r[1] for r in rows}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontaminate", "encode"]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, d)
        out.write.parquet(f"{d}/{name}")
        docs = spark.read.parquet(f"{d}/{name}")
        got = {r.doc_id: r for r in docs.collect()}
        assert docs.count() == len(got)
        if name != "encode":
            assert docs.columns == [c.split()[0] for c in SCHEMA.split(", ")]
        if name == "language_id":
            assert {i: r.text for i, r in got.items()} == {i: t for i, t in before.items() if i not in (51, 52, 53)}
            assert all(r.lang == ("aa", "bb")[i % 2] for i, r in got.items() if i < 36) and got[54].lang == "aa"
        elif name == "line_dedup":
            want = {i: "\n".join(x) for i, x in plain_dedup(list(before.items())).items()}
            want = {i: t for i, t in want.items() if t == before[i] or plain_form(t)}
            assert {i: r.text for i, r in got.items()} == want and len(want) < len(before)
            assert all(r.n_chars == len(r.text) for r in got.values())
        elif name == "near_dedup":
            fps = {i: plain_fingerprint(t) for i, t in before.items()}
            root = plain_components(set(fps.values()))
            assert set(got) == {min(i for i in fps if root[fps[i]] == c) for c in set(root.values())}
        elif name == "decontaminate":
            leaked = {i for i, _ in plain_leaks(list(before.items()), items)}
            assert leaked and set(got) == set(before) - leaked
        else:
            for i, r in got.items():
                assert r.round_trip and r.ids == [p for u in sp_lattice.units(before[i]) for p in sp_lattice.encode_units([u])[0]]
            assert set(got) == set(before)
        before = {i: r.text for i, r in got.items()} if name != "encode" else before
    whole = corpus_pipeline.run(spark, d)
    assert {r.doc_id: r.ids for r in whole.collect()} == {i: r.ids for i, r in got.items()}


def test_near_dedup_joins_by_fingerprints_and_by_sets(spark):
    """Documents 3 bits apart go that share less than 0.8, and those that share 0.8 and are further apart; one chain of both kinds is one group."""
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    flat = lambda n: [r.choice(words) for _ in range(n)]
    shared, sets = lambda a, b: len(a & b) / len(a | b), lambda t: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)}
    bits = lambda a, b: bin(plain_fingerprint(a) ^ plain_fingerprint(b)).count("1")
    # The same three words, over and over, decide the fingerprint; what stands around them the sets of five words.
    tail = " ".join(flat(30))
    loop = "x y z " * 40
    a, b = loop + " ".join(flat(12)) + " " + tail, loop + " ".join(flat(12)) + " " + tail
    assert bits(a, b) <= 3 and shared(sets(a), sets(b)) < 0.8
    while True:
        c = flat(100)
        d = list(c)
        for i in r.sample(range(100), 2):
            d[i] = r.choice(words)
        c, d = " ".join(c), " ".join(d)
        if bits(c, d) > 3 and shared(sets(c), sets(d)) >= 0.83:
            break
    rows = [(1, a), (2, b), (3, c), (4, d), (5, " ".join(flat(100))), (6, a), (6, a), (7, None), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], SCHEMA)
    assert sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3, 5, 7]
