import math
import random

import numpy as np
import pytest

from tracewell.llm import langid
from tracewell.llm.lattice import Lattice
from tracewell.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, held_out boolean, score string"


def all_segmentations(word, vocabulary, p):
    """Sum over every way to cut the word, by trying all of them."""
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, len(word) + 1):
        i = vocabulary.get(word[:k], 0 if k == 1 else None)
        if i is not None:
            total += p[i] * all_segmentations(word[k:], vocabulary, p)
    return total


@pytest.fixture(scope="module")
def vocabulary():
    return langid.pieces()


def test_forward_sums_all_segmentations(vocabulary):
    r = np.random.default_rng(1)
    p = r.random((len(vocabulary), 2)) * 1e-2
    place = {x: i for i, x in enumerate(vocabulary) if i}
    words = ["the", "straße", "x", "zzq", "éàü", "引擎", "internationals", "ab"]
    got = Lattice(vocabulary).scores(langid.marked(words), p)
    for w, row in zip(words, got):
        for i in (0, 1):
            assert math.isclose(row[i], math.log(all_segmentations("▁" + w, place, p[:, i])), rel_tol=1e-9)


def test_expected_counts(vocabulary):
    """The gradient of the log probability by a piece's log probability is the piece's expected count."""
    r = np.random.default_rng(2)
    p = r.random(len(vocabulary)) * 1e-2
    lattice, words, counts = Lattice(vocabulary), langid.marked(["another", "the", "qx"]), np.array([2.0, 1.0, 5.0])
    got = lattice.expected(words, counts, p)
    for i in np.flatnonzero(got)[:12]:
        q = p.copy()
        q[i] *= 1 + 1e-6
        change = (lattice.scores(words, q[:, None]) - lattice.scores(words, p[:, None]))[:, 0] @ counts
        assert math.isclose(got[i], change / 1e-6, rel_tol=1e-3)


def test_edge_cases(spark):
    r = random.Random(1)
    rows = []
    for i in range(60):
        lang = ("aa", "bb")[i % 2]
        syllables = {"aa": ["lo", "mi", "na"], "bb": ["ster", "krux", "pf"]}[lang]
        rows.append((i, " ".join("".join(r.choices(syllables, k=3)) for _ in range(20)), lang, None, None))
    docs = spark.createDataFrame([*rows, (None, None, "aa", None, None), (61, "12 ½ --", "bb", None, None), (62, "", None, None, None), (63, "lomi " * 50_000, None, None, None), (63, "a" * 5000, None, None, None)], SCHEMA)
    got = langid.predict(docs, langid.fit(docs), carry=("doc_id", "lang")).collect()
    assert len(got) == 65
    for x in got:
        if x.doc_id is None or x.doc_id in (61, 62):
            assert (x.lang_pred, x.score) == ("und", 0.0)
        elif x.doc_id == 63:
            assert x.lang_pred in ("aa", "bb")
        else:
            assert x.lang_pred == x.lang and 0.5 <= x.score <= 1


def test_nothing_to_learn_or_predict(spark):
    docs = spark.createDataFrame([(1, "some text", None, None, None)], SCHEMA)
    assert [tuple(x) for x in langid.predict(docs, langid.fit(docs)).collect()] == [(1, "und", 0.0)]
    none = docs.where("false")
    assert langid.predict(none, langid.fit(none)).count() == 0


def test_held_out_accuracy(spark):
    got = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id").where("held_out").collect()
    assert len(got) > 100
    assert sum(x.lang == x.lang_pred for x in got) / len(got) > 0.95


def test_held_out_rows_never_teach(spark, tmp_path):
    """held_out is the CRC-32 of doc_id as text, modulo 5; other langs on held-out rows leave every prediction as it was."""
    import zlib

    from pyspark.sql import functions as F

    from tracewell.llm.queries import QUERIES

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    own = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    for name, lang in (("a", F.col("lang")), ("b", F.when(own, F.lit("zz")).otherwise(F.col("lang")))):
        docs.withColumn("lang", lang).write.parquet(str(tmp_path / name / "documents.parquet"))
    a, b = ({r.doc_id: (r.held_out, r.lang_pred, r.score) for r in QUERIES["op1_language_id"](spark, str(tmp_path / n)).collect()} for n in "ab")
    assert a == b and all(held == (zlib.crc32(str(i).encode()) % 5 == 0) for i, (held, *_) in a.items())
    assert "zz" not in {lang for _, lang, _ in b.values()} and 0.1 < sum(held for held, *_ in a.values()) / len(a) < 0.3
