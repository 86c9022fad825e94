"""Search for existing functions, hard-coded patterns, prose in TeX, modules that are loaded while a program runs."""

import math
import random
from collections import Counter

import pytest

from tracewell.operators import retrieval
from tracewell.functions import text as T
from tracewell.scanners import contracts, deadcode, hardcoded, prose, reuse
from tracewell.sources import pysource, tex
from pyspark.sql import functions as F

FILES = {
    "lib/io.py": "def load_json(path):\n    \"\"\"Load a JSON file from a path.\"\"\"\n    with open_text(path) as f:\n        return parse(f.read(), mode='checkpoint strict')\n\ndef mean(xs):\n    total = 0\n    for x in xs:\n        total += x\n    return total / count(xs)\n",
    "new/a.py": "def read_config(path):\n    \"\"\"Load a JSON file.\"\"\"\n    return parse(open_text(path).read(), mode='checkpoint strict')\n\ndef average(values):\n    s = 0\n    for v in values:\n        s += v\n    return s / count(values)\n\ndef both(p):\n    return average(read_config(p))\n",
}


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(p, t.encode()) for p, t in FILES.items()], "path string, content binary")
    return reuse.index(pysource.symbols(files)).cache()


def test_channels(found):
    old, new = found.where("key LIKE 'lib/%'"), found.where("key LIKE 'new/%'")
    rows = {(r["query"], r.key): r for r in reuse.for_symbols(new, old).collect()}
    config = rows["new/a.py:read_config", "lib/io.py:load_json"]
    assert config.call >= 0.9 and config.string == 1.0 and 0 < config.lexical < 1 and config.score == max(config.structural, config.call, config.string, round(config.lexical * 0.8, 4)) and config.rank == 1
    assert rows["new/a.py:average", "lib/io.py:mean"].structural == 1.0
    assert ("new/a.py:both", "lib/io.py:load_json") not in {k for k, r in rows.items() if r.call or r.string}
    near = {(r["query"], r.key): r.score for r in reuse.for_symbols_with_closure(new, old).collect()}
    assert near["new/a.py:both", "lib/io.py:mean"] == 1.0 and near["new/a.py:both", "lib/io.py:load_json"] == config.score
    assert [r.key for r in reuse.pairs(reuse.for_symbols(new.where("name = 'average'"), old, least=0.9)).collect()] == ["lib/io.py:mean"]
    assert reuse.for_symbols(old, old).where("query = key").count() == 0


def test_descriptions(spark, found):
    asked = spark.createDataFrame([("a", "load json"), ("b", "restore a checkpoint"), ("c", "")], "key string, text string")
    rows = {(r["query"], r.key): r for r in reuse.for_descriptions(asked, found).collect()}
    assert rows["a", "lib/io.py:load_json"].name == 1.0 and rows["a", "lib/io.py:load_json"].score == 1.0 and rows["a", "new/a.py:read_config"].score == 0.8
    assert 0 < rows["b", "lib/io.py:load_json"].string and not any(q == "c" for q, _ in rows)
    cut = spark.createDataFrame([("loadJson2",)], "n string").select(T.name_tokens("n")).first()[0]
    assert cut == ["json", "load"]


def test_unknown_tokens_weigh_one(spark):
    sets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "key int, token string")
    asked = spark.createDataFrame([("q", "a"), ("q", "zz")], "key string, token string")
    weights = retrieval.idf(sets, 2)
    a = math.log(3 / 3) + 1
    assert {r.key: r.score for r in retrieval.coverage(asked, sets, weights).collect()} == {1: round(a / (a + 1), 6), 2: round(a / (a + 1), 6)}
    assert retrieval.weighted_jaccard(asked, sets, weights).where("key = 2").first().score == round(a / (a + 1), 6)


def test_bounded_search_is_the_whole_search(spark, monkeypatch):
    """Against every pair, for each measure, with rounds of a few postings; and that common tokens aren't joined."""
    r = random.Random(3)
    words, weights = [f"w{i}" for i in range(120)], [1 / (i + 1) for i in range(120)]
    draw = lambda n: {w for w in r.choices(words, weights, k=n)}
    own = {i: draw(r.randrange(2, 40)) for i in range(150)}
    own |= {200 + i: own[7] for i in range(6)}
    asked = {300 + i: draw(r.randrange(1, 25)) | ({"unknown"} if i % 3 else set()) for i in range(25)} | {1: own[1], 999: {"unknown"}}
    frame = lambda d: spark.createDataFrame([(k, t) for k, s in d.items() for t in sorted(s)], "key int, token string")
    sets, queries = frame(own), frame(asked)
    df = Counter(t for s in own.values() for t in s)
    idf = {t: math.log((len(own) + 1) / (n + 1)) + 1 for t, n in df.items()}
    weigh = lambda s: sum(idf.get(t, 1.0) for t in s)
    score = {
        "jaccard": lambda q, x: weigh(q & x) / weigh(q | x), "coverage": lambda q, x: weigh(q & x) / weigh(q),
    }
    monkeypatch.setattr(retrieval, "FIRST", 2)
    monkeypatch.setattr(retrieval, "GROWTH", 3)
    made, real = [], retrieval.scored
    monkeypatch.setattr(retrieval, "scored", lambda p, *a: (made.append(p.count()), real(p, *a))[1])
    table = retrieval.vocabulary(retrieval.idf(sets, len(own)))
    tokens, index = retrieval.asked(queries, table), retrieval.records(sets, table)
    for name, measure in (("jaccard", retrieval.JACCARD), ("coverage", retrieval.COVERAGE)):
        every = {q: sorted(((-round(score[name](s, x), 6), i) for i, x in own.items() if s & x and i != q)) for q, s in asked.items()}
        made.clear()
        got = {(r["query"], r["rank"]): (r.key, r.score) for r in retrieval.top(tokens, index, measure, 4, other=True).collect()}
        assert got == {(q, n): (i, pytest.approx(-s, abs=2e-6)) for q, rows in every.items() for n, (s, i) in enumerate(rows[:4], 1)}
        assert sum(made) < 0.7 * sum(map(len, every.values()))
        floors = spark.createDataFrame([(q, 0.3) for q in asked], "query int, floor double")
        assert {(r["query"], r.key) for r in retrieval.at_least(tokens, index, measure, floors, other=True).collect()} == {(q, i) for q, rows in every.items() for s, i in rows if -s >= 0.3}
    assert retrieval.top(tokens.where("false"), index, retrieval.JACCARD, 4).count() == 0


def test_hardcoded(spark):
    text = "import hashlib\nx = hashlib.sha256(b)\ny = norm_f(\n  h.mean(dim=1))\nz = a.mean(dim=1); w = hashlib.sha256(c)\n"
    docs = spark.createDataFrame([("lib/a.py", text), ("tests/b.py", text), ("lib/c.py", "x = 1")], "path string, text string")
    got = sorted((r.pattern, r.line, r.code) for r in hardcoded.hardcoded(docs).collect())
    assert got == [("manual_sha256", 2, "x = hashlib.sha256(b)"), ("manual_sha256", 5, "z = a.mean(dim=1); w = hashlib.sha256(c)"), ("readout_pool_then_ln_inline", 3, "y = norm_f(")]
    assert hardcoded.hardcoded(docs, every=True).count() == 5
    own = (hardcoded.Pattern("one", r"x = ", "high", ("lib/c.py",)),)
    assert [r.path for r in hardcoded.hardcoded(docs, own).collect()] == ["lib/a.py"]
    quiet = spark.createDataFrame([("lib/a.py", "manual_sha256")], "path string, pattern string")
    assert hardcoded.hardcoded(docs, suppressed=quiet).count() == 1


def test_prose(spark):
    source = "\\begin{document}\nNote that this is so. However, it is not. We have $a=1$ one; $b$ two; three of $c$ them. It is robust to noise. It is robust. A moreover B \\pm C --- not just D but E.\n\\end{document}"
    docs = tex.documents(spark.createDataFrame([("docs/a.tex", source.encode()), ("docs/legacy/b.tex", source.encode())], "path string, content binary"))
    got = {(r.channel, r.severity) for r in prose.findings(docs).collect()}
    assert {("note_that", "low"), ("template_openers", "medium"), ("excess_vocab", "medium"), ("pm_format", "low"), ("semicolon_chains", "medium"), ("em_dash_rate", "medium")} <= got
    assert {r.path for r in prose.findings(docs).collect()} == {"docs/a.tex"}
    vocabulary = {r.text for r in prose.findings(docs).where("channel = 'excess_vocab'").collect()}
    assert vocabulary == {"moreover x1", "robust x1"}


def test_couplings(spark):
    a = "import importlib\nfrom importlib import util\nm = importlib.import_module('lib.x')\nspec = util.spec_from_file_location('n', PATH / 'y.py')\nn = util.module_from_spec(spec)\nfor each in (m, n.inner):\n    each.MODE = 1\nn.deep.LIMIT += 2\nother.MODE = 3\n"
    files = spark.createDataFrame([("a.py", a.encode()), ("b.py", b"import importlib\nm = importlib.import_module(name)\n"), ("c.py", b"x.y = 1\n")], "path string, content binary")
    rows = {r.path: r for r in contracts.dynamic_module_runtime_coupling(pysource.couplings(files)).collect()}
    assert set(rows) == {"a.py", "b.py"}
    assert rows["a.py"].priority == "high" and rows["a.py"].line == 3 and rows["a.py"].module_bindings == ["m", "n"] and rows["a.py"].state_attributes == ["LIMIT", "MODE"]
    assert [(x.kind, x.binding, x.source) for x in rows["a.py"].loads] == [("import", "m", "'lib.x'"), ("file", "spec", "PATH / 'y.py'")]
    assert rows["b.py"].kind == "dynamic_module_load" and rows["b.py"].priority == "medium"


def test_contract_rules(spark):
    own = {
        "lib/a.py": "def main(): pass\ndef shared(): pass\ndef __x__(): pass\ndef fwd(*a, **k):\n    return make()(*a, **k)\n", "tools/b.py": "def main(): pass\ndef shared(): pass\ndef load_model(): pass\n",
        "tools/c.py": "def load_model(): pass\nimport torch\ntorch.load(p, weights_only=False)\n", "tests/t.py": "def alone(): pass\n", "tools/d.py": "import importlib\nimportlib.import_module('lib.a.shared')\ndef test_x(): pass\n",
    }
    files = spark.createDataFrame([(p, t.encode()) for p, t in own.items()], "path string, content binary")
    symbols, facts = pysource.symbols(files).cache(), pysource.facts(files).cache()
    assert {r.name for r in contracts.same_name(symbols).collect()} == {"shared", "load_model"}
    assert [(r.path, r.kind) for r in contracts.defensive_param_loosening(facts).collect()] == [("tools/c.py", "weights_only_false")]
    assert [(r.qualname, r.target, r.passes_varargs, r.passes_kwargs) for r in contracts.forwarding_wrappers(symbols).collect()] == [("fwd", "make()", True, True)]
    lost = {(r.path, r.qualname) for r in contracts.unreferenced(symbols, facts).collect()}
    assert not {q for _, q in lost} & {"__x__", "test_x", "alone"} and ("lib/a.py", "fwd") in lost
    long = "/".join(["p"] * 60) + "/tools/b.py"
    texts = spark.createDataFrame([("tools/c.py", long)], "path string, text string")
    status = {r.path: r.status for r in deadcode.deadcode(facts, texts).collect()}
    assert status["lib/a.py"] == "USED" and status["tools/b.py"] == "USED"  # the longest module that a name begins with; the end of a long path


def test_index_of_asked_tokens_finds_the_same(spark):
    """An index of the queries' tokens alone gives what one of every token gives, and holds no other token; a record without one isn't in it."""
    from pyspark.sql import functions as F

    own = {k: {f"t{(k * m) % 23}" for m in (1, 2, 3, 5)} | {f"own{k}"} for k in range(1, 20)} | {50: {"alone"}}
    sets = spark.createDataFrame([(k, t) for k, x in own.items() for t in sorted(x)], "key long, token string")
    queries = spark.createDataFrame([(1, t) for t in ("t1", "t4", "t9", "none")] + [(2, t) for t in ("t2", "t4")], "key long, token string")
    for measure, even, wx in ((retrieval.JACCARD, False, "weights"), (retrieval.JACCARD, True, "even"), (retrieval.COVERAGE, False, "shared")):
        weights = retrieval.idf(sets, len(own)).withColumn("idf", F.lit(1.0) if even else F.col("idf"))
        every, few = retrieval.vocabulary(weights), retrieval.vocabulary(weights, queries)
        index = retrieval.records(sets, few, weights if wx == "weights" else wx)
        want = retrieval.top(retrieval.asked(queries, every), retrieval.records(sets, every), measure, 5)
        got = retrieval.top(retrieval.asked(queries, few), index, measure, 5)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() == 10
        held = {r.key: len(r.tokens) for r in index.collect()}
        assert held == {k: n for k, x in own.items() if (n := len(x & {"t1", "t2", "t4", "t9"}))}


def test_few_places_are_shuffled(spark, monkeypatch):
    """Weights of frequent tokens, and pairs, go to the records: the rows are those of shuffled joins, and no shuffle stands under the index when it is scored."""
    sets = spark.createDataFrame([(k, f"t{t}") for k in range(60) for t in range(1, 40) if k % t == 0], "key long, token string")
    queries = spark.createDataFrame([(q, f"t{t}") for q in range(5) for t in range(1, 12 + q) if (q + t) % 3], "key long, token string")
    weights = retrieval.stash(retrieval.idf(sets, 60), "idf")
    words = retrieval.vocabulary(weights, queries)
    rows = lambda: sorted(tuple(x) for x in retrieval.weighted_jaccard(queries, sets, weights, 4).collect())
    want = rows()
    plain = sorted(((x.key, x.token, round(x.idf, 9), x.id) for x in sets.join(weights.select("token", "idf"), "token").join(words.select("token", "id"), "token", "left").collect()), key=str)
    seen = []
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 6)
    got = retrieval._weighed(sets, weights, words)
    assert sorted(((x.key, x.token, round(x.idf, 9), x.id) for x in got.collect()), key=str) == plain and rows() == want
    monkeypatch.setattr(retrieval, "BROADCAST_QUERIES", 200_000)
    index, asked = retrieval.records(sets, words, weights), retrieval.asked(queries, words)
    pairs = spark.createDataFrame([(q, k) for q in range(5) for k in range(60)], "query long, key long")
    score = lambda: retrieval.scored(pairs, asked, index, retrieval.JACCARD, True)
    seen = [score()._jdf.queryExecution().executedPlan().toString(), sorted(map(tuple, score().collect()))]
    monkeypatch.setattr(retrieval, "BROADCAST_PAIRS", 0)
    assert seen[0].count("Exchange hashpartitioning(key") == 0 and sorted(map(tuple, score().collect())) == seen[1]
