"""The line table: snippets, stale entries, moved lines, evidence in one line."""

import json

import pytest

from tracewell.operators import lines

A = "import os\n\ndef one(x):\n    return x\n\n\ndef two():\n    return 2\n"
LONG = "".join(f"row {i}\n" for i in range(1, 101))


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([("lib/a.py", A), ("lib/long.py", LONG), ("lib/empty.py", ""), ("x/odd.py", "a\r\nb\x0cc\rd")], "path string, text string")


def test_lines_end_as_python_ends_them(spark):
    said = ["", "a", "a\n", "\n", "a\n\nb", "a\r\nb\rc\n", "a\x0bb\x0cc\x1cd\x1de\x1ef\x85g h ", "\r\n\r\n"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string").select("i", lines.split_lines("t").alias("l")).collect()
    assert {r.i: r.l for r in got} == {i: t.splitlines() for i, t in enumerate(said)}


def test_snippets(spark, texts):
    row = lambda scanner, target, **detail: (scanner, target, json.dumps(detail))
    found = spark.createDataFrame([
        row("duplicates", "d", members=["lib/a.py:one", "lib/a.py:two#2", "lib/gone.py:x", "lib/long.py:none", "lib/a.py:one"]), row("regions", "r", members=["lib/long.py:f:95-99"]),
        row("forks", "f", key="lib/a.py:two::lib/long.py:g"), row("hardcoded", "h", path="lib/long.py", line=29, code="x"), row("capabilities", "c", local="lib/a.py:one", lib="l"),
        row("deadcode", "e", path="lib/empty.py", line=1), row("contracts", "n", value=3),
    ], "scanner string, target_id string, detail string")
    symbols = spark.createDataFrame([("lib/a.py", "one", 3), ("lib/a.py", "two", 7), ("lib/long.py", "g", 50), ("lib/long.py", "g", 40)], "path string, qualname string, line int")
    places = lines.locations(found)
    assert places.where("target_id = 'd'").count() == lines.FILES and places.where("target_id = 'n'").count() == 0
    got = {(r.target_id, r.n): (r.start_line, r.code, r.error) for r in lines.snippets(places, texts, symbols).collect()}
    cut = lambda text, first: "".join(f"L{i}: {t}\n" for i, t in enumerate(text.splitlines(), 1) if first <= i < first + 30)
    assert got == {
        ("d", 0): (3, cut(A, 3), None), ("d", 1): (7, cut(A, 7), None), ("d", 2): (None, None, "file not found"), ("d", 3): (None, None, "location not found"), ("r", 0): (95, cut(LONG, 95), None),
        ("f", 0): (7, cut(A, 7), None), ("f", 1): (40, cut(LONG, 40), None), ("h", 0): (29, cut(LONG, 29), None), ("c", 0): (3, cut(A, 3), None), ("e", 0): (1, "", None),
    }


def test_stale_entries(spark, texts):
    entries = spark.createDataFrame([
        ("deadcode", None, "lib/a.py"), ("deadcode", None, "lib/none.py"), ("duplicates", "abc", None), ("forks", "lib/a.py:one::lib/none.py:two", None), ("contracts/env", "lib/a.py:3:one", None),
        ("contracts/env", "lib/a.py:2:two", None), ("contracts/env", "lib/a.py:99:two", None), ("contracts/env", "lib/a.py:three", None), ("capabilities", "lib/a.py:two", None), ("capabilities", "lib/a.py:four", None),
        ("contracts/env", "lib/a.py:1:four", None),
    ], "section string, key string, path string")
    got = sorted(((r.section, r.key, r.reason, r.moved_to) for r in lines.stale_places(lines.entry_places(entries), texts).collect()), key=str)
    assert got == sorted([
        ("deadcode", "lib/none.py", "file missing: lib/none.py", None), ("forks", "lib/a.py:one::lib/none.py:two", "file missing: lib/none.py", None),
        ("contracts/env", "lib/a.py:2:two", "line 2 no longer defines `two`", 7), ("contracts/env", "lib/a.py:99:two", "line 99 gone", 7), ("contracts/env", "lib/a.py:three", "symbol `three` gone", None),
        ("capabilities", "lib/a.py:four", "symbol `four` gone", None), ("contracts/env", "lib/a.py:1:four", "line 1 no longer defines `four`", None),
    ], key=str)


def test_moved_is_told_from_gone(spark, texts):
    was = {r.line: r.line_hash for r in lines.line_table(texts.where("path = 'lib/a.py'")).collect()}
    now = spark.createDataFrame([("lib/a.py", "# new\n# newer\n" + A.replace("return 2", "return 3"))], "path string, text string")
    places = spark.createDataFrame([("s", f"k{i}", "lib/a.py", i, None, was[i]) for i in (1, 3, 8)], "section string, key string, path string, line int, symbol string, line_hash string")
    got = sorted((r.key, r.reason, r.moved_to) for r in lines.stale_places(places, now).collect())
    assert got == [("k1", "line 1 has changed", 3), ("k3", "line 3 has changed", 5), ("k8", "line 8 has changed", None)]
    carried = {r.line: r.now_line for r in lines.carried(lines.line_table(texts.where("path = 'lib/a.py'")), lines.line_table(now)).collect()}
    assert carried == {1: 3, 2: 4, 3: 5, 4: 6, 5: 7, 6: 8, 7: 9}


def test_evidence(spark):
    rows = [
        ("deadcode", {"status": "DEAD", "py_refs": 0}, "status=DEAD py_refs=0 doc_refs=None"), ("regions", {"kind": "k", "priority": "high", "risk_signals": ["a", "b"], "semantic_risk": "low"}, "kind=k priority=high risk=low signals=a,b canonical=none"),
        ("regions", {"kind": "k", "risk_signals": [], "canonical": "a.py:f"}, "kind=k priority=None risk=None signals=- canonical=a.py:f"), ("forks", {"similarity": 0.9, "kind": "fork", "signature_match": True, "key": "a:f::b:g"}, "sim=0.9 kind=fork sig=true left=a:f right=b:g"),
        ("contracts", {"x": "y" * 500}, json.dumps({"x": "y" * 500})[:400]), ("other", {}, ""),
    ]
    found = spark.createDataFrame([(s, str(i), json.dumps(d)) for i, (s, d, _) in enumerate(rows)], "scanner string, target_id string, detail string")
    assert [r.evidence for r in lines.evidence_lines(found).orderBy("target_id").collect()] == [want for *_, want in rows]
