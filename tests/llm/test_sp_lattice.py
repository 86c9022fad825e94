import pytest

from tracewell.llm import sp_lattice
from tracewell.llm.common import table

TEXTS = ["", "Hello world", "  two  spaces\n\n and \t tabs ", "straße über naïve 引擎 🦜🦜", "a▁literal ▁ mark", " ", "\n", "x" * 3000, "aaaa " * 50, "The the. THE, don't stop-words!", "\x00\x01 control"]


@pytest.fixture(scope="module")
def vocabulary():
    return sp_lattice.Vocabulary()


def plain_best(unit, v):
    """The best path by trying every piece at every place, from left to right."""
    if unit == "▁":
        return v.byte_ids("▁")
    unit = unit.replace(" ", "▁")
    table = dict(zip(v.pieces, zip(v.ids, v.scores)))
    longest = max(map(len, table))
    best = [(0.0, 0, ())]
    for end in range(1, len(unit) + 1):
        found = []
        for start in range(max(0, end - longest), end):
            piece = unit[start:end]
            if piece in table:
                found.append((best[start][0] + table[piece][1], -start, (*best[start][2], table[piece][0])))
            elif end == start + 1:
                found.append((best[start][0] + v.unknown, -start, (*best[start][2], *v.byte_ids(piece))))
        best.append(max(found, key=lambda x: x[:2]))
    return list(best[-1][2])


def test_units_join_to_the_text():
    for t in TEXTS:
        assert "".join(sp_lattice.units(t)) == (" " + t if t else "")


def test_units_of_many_texts():
    texts = [*TEXTS, None, "", "a  \n b", " \n", "end "]
    joined, starts, ends, hashes, counts = sp_lattice.Units()(texts)
    got, at = [joined[i:j] for i, j in zip(starts, ends)], 0
    for t, n in zip(texts, counts):
        assert got[at : at + n] == sp_lattice.units(t or "")
        at += n
    assert at == len(got)
    assert len(dict(zip(hashes.tolist(), got))) == len(set(got)) == len(set(hashes.tolist()))


def test_against_plain_path(vocabulary):
    some = sorted({u for t in TEXTS for u in sp_lattice.units(t)} - {" " + "x" * 3000})
    assert sp_lattice.encode_units(some) == [plain_best(u, vocabulary) for u in some]


def test_relational_lexicon_is_the_same(spark, vocabulary):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(60)
    some = {u for r in docs.collect() for u in sp_lattice.units(r.text)} | {u for t in TEXTS for u in sp_lattice.units(t)}
    some = sorted(u for u in some if len(u) <= 40 and u != "▁")[:1500]
    got = sp_lattice.lexicon(spark.createDataFrame([(u,) for u in some], "unit string"), vocabulary).collect()
    got = {r.unit: [j for i in r.path for j in ([i] if i >= 0 else vocabulary.byte_ids(chr(-1 - i)))] for r in got}
    assert got == dict(zip(some, sp_lattice.encode_units(some)))


def test_documents_round_trip(spark, vocabulary):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, None, None, None), (3, TEXTS[3], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_pieces int")
    for size in (0, 5, 1000):
        encoded = sp_lattice.encode(docs, size=size).cache()
        got = encoded.collect()
        assert len(got) == len(rows)
        for x in got:
            text = None if x.doc_id is None else TEXTS[x.doc_id]
            if text is None:
                assert x.ids is None and x.round_trip is None
            else:
                assert x.round_trip and x.n_pieces == len(x.ids)
                assert x.ids == [i for u in sp_lattice.units(text) for i in sp_lattice.encode_units([u])[0]]
        assert sorted(map(str, sp_lattice.decode(encoded).collect())) == sorted(map(str, docs.select("doc_id", "text").collect()))
    assert sp_lattice.encode(docs.where("false")).count() == 0


def test_the_library_reads_the_ids_as_the_same_text():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=sp_lattice.vocabulary_path())
    for t in TEXTS:
        if "▁" not in t and t:
            ids = [i for own in sp_lattice.encode_units(sp_lattice.units(t)) for i in own]
            assert model.decode(ids) == model.decode(model.encode(t)) == t
