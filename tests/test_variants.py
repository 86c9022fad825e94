"""JSON of any depth as rows; locks found in it."""

import hashlib
import json

from tracewell.functions import variants
from tracewell.sources import locks


def plain(node, path=(), key=None):
    if isinstance(node, dict) and node:
        return [x for k, v in node.items() for x in plain(v, (*path, k), k)]
    if isinstance(node, list) and node:
        return [x for i, v in enumerate(node) for x in plain(v, (*path, f"[{i}]"), key)]
    kind = "empty" if isinstance(node, dict | list) else "string" if isinstance(node, str) else "boolean" if isinstance(node, bool) else "null" if node is None else "number"
    return [(path, key, kind, None if kind in ("empty", "null") else node if kind == "string" else json.dumps(node))]


DOCS = [
    {"a": 1, "b": [1, "x", {"c": None, "d": [[], {}, [True]]}], "e.f": {"g": 2.5}}, [], {}, [[1, [2, [3]]]], "text", 7, None, {"": {"": "deep"}}, {"x": '{"not": "opened"}', "é": "ü"},
]


def test_leaves(spark):
    rows = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(90, "{broken"), (91, None), (92, "")], "id int, said string")
    got = sorted(((r.id, tuple(r.path), r.key, r.kind, r.value) for r in variants.leaves(rows, "said").collect()), key=str)
    assert got == sorted(((i, *x) for i, d in enumerate(DOCS) for x in plain(d)), key=str)
    deep = 1
    for _ in range(12):
        deep = {"k": [deep]}
    one = variants.leaves(spark.createDataFrame([(json.dumps(deep),)], "said string"), "said").first()
    assert len(one.path) == 24 and one.value == "1" and one.key == "k"


def test_counts(spark):
    rows = spark.createDataFrame([("r", json.dumps({"m": [{"n": 1}, {"n": 2}, {"n": 2}], "s": {"t": "x"}}))], "file string, said string")
    got = sorted((r.file, r.pointer, r.kind, r.n, r.distinct) for r in variants.counts_by_path(variants.leaves(rows, "said"), ["file"]).collect())
    assert got == [("r", "m[].n", "number", 3, 2), ("r", "s.t", "string", 1, 1)]


def test_locks_at_any_depth(spark):
    h = hashlib.sha256(b"x").hexdigest()
    manifest = {"files": {"./lib/a.py": h, "lib\\b.py": h, "lib/none.py": h, "no path": h, "lib/c.py": "short"}, "more": [{"deep": {"lib/c.py": h}}, [{"lib/a.py": h.upper()}]]}
    content = spark.createDataFrame([("locks/m.json", json.dumps(manifest).encode()), ("locks/n.json", json.dumps({"lib/a.py": h}).encode()), ("bad.json", b"{"), ("odd.json", b"\xff\xfe")], "path string, content binary")
    files = spark.createDataFrame([("lib/a.py",), ("lib/b.py",), ("lib/c.py",)], "path string")
    assert sorted((r.path, r.manifests) for r in locks.locked_files(content, files).collect()) == [("lib/a.py", ["locks/m.json", "locks/n.json"]), ("lib/b.py", ["locks/m.json"]), ("lib/c.py", ["locks/m.json"])]
