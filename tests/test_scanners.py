"""The source scanners over small projects written for each rule."""

import hashlib
import json
import time
from difflib import SequenceMatcher

import pytest

from tracewell.functions.sequences import covered, ratio
from tracewell.scanners import capabilities, contracts, deadcode, duplicates, hardcoded
from tracewell.sources import files, locks, pysource

BODY = '''
def {name}(items, limit):
    """Words of {name}."""
    total = 0
    for item in items:
        if item.value > limit:
            total += item.value * 2
        else:
            total -= item.weight
    return total
'''


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("project") / "pkg"
    own = {
        "__init__.py": "",
        "lib/shared.py": BODY.format(name="shared") + "\ndef load_table(path):\n    \"\"\"Load a table of numbers from a path.\"\"\"\n    return open(path).read()\n",
        "experiments/a.py": "from lib.shared import shared\n" + BODY.format(name="alpha") + "\nif __name__ == '__main__':\n    alpha([], 0)\n",
        "experiments/b.py": BODY.format(name="beta").replace("* 2", "* 2 + 1") + "\ndef beta(items, limit): ...\n\ndef read_table(path):\n    '''Load a table of numbers from path.'''\n    return helper(path)\n",
        "experiments/env.py": "import os\nos.environ['LOST'] = '1'\nos.environ['USED'] = '2'\nprint(os.getenv('USED'))\n",
        "experiments/gen.py": "NAME = 'generation_a'\nmodel.load_state_dict(x, strict=False)\n",
        "experiments/dynamic.py": "import importlib, sys\nsys.path.insert(0, 'pkg/tools')\nimport extra\nimportlib.import_module('lib.plugin')\n\ndef _load(name, path):\n    return spec_from_file_location(name, path)\n\n_load('x', 'late.py')\n",
        "experiments/late.py": "x = 1\n",
        "lib/plugin.py": "y = 1\n",
        "tools/extra.py": "z = 1\n",
        "tools/lonely.py": "def nobody():\n    return 1\n",
        "tools/named.py": "n = 1\n",
        "tools/talk.py": "SCRIPT = 'tools/named.py'\n",
        "tools/broken.py": "def (:\n",
        "tests/test_x.py": "﻿from experiments import a\n",
        "build/skipped.py": "import nothing\n",
    }
    for path, text in own.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text, encoding="utf-8")
    (root / "notes.md").write_text("see `lonely` for more")
    (root / "lock.json").write_text(json.dumps({"audit_id": "a" * 64, "files": {"lib/shared.py": "b" * 64, "gone.py": "c" * 64}, "x_sha256": "d" * 64}))
    return str(root)


@pytest.fixture(scope="module")
def scanned(spark, project):
    found = files.scan(spark, project)
    return found, pysource.symbols(found).cache(), pysource.facts(found).cache()


def test_scan(spark, scanned):
    paths = {r.path for r in scanned[0].select("path").collect()}
    assert "lib/shared.py" in paths and "build/skipped.py" not in paths and len(paths) == 15
    texts = {r.path: r.text for r in files.texts(scanned[0]).collect()}
    assert texts["tests/test_x.py"].startswith("from")


def test_symbols(scanned):
    rows = {(r.path, r.qualname, r.start_line): r for r in scanned[1].collect()}
    shared = rows["lib/shared.py", "shared", 2]
    assert shared.normalized.startswith("def _function(_arg, _arg): _name = 0 for _name in _name:") and "_name.value > _name" in shared.normalized
    assert shared.sig_shape == "(p, p)" and shared.n_lines == 9 and shared.doc == "Words of shared." and shared.returns_value
    assert any(r.stub for k, r in rows.items() if k[1] == "beta") and not rows["experiments/b.py", "beta", 2].stub
    assert [r.forwards_to for k, r in rows.items() if k[1] == "read_table"] == ["helper"]


def test_failures_are_rows(scanned):
    assert [r.path for r in scanned[2].where("kind = 'failure'").collect()] == ["tools/broken.py"]


def test_duplicates(scanned):
    found = duplicates.duplicates(scanned[1], min_chars=0).collect()
    top = found[0]
    assert top.members == ["experiments/a.py:alpha", "experiments/b.py:beta", "lib/shared.py:shared"]
    assert top.size == 3 and top.file_count == 3 and top.priority == "high" and top.max_sim == 1.0 and 0.82 <= top.min_sim < 1
    assert top.id == hashlib.sha256("\n".join(top.members).encode()).hexdigest()[:12]


def test_forks(scanned):
    rows = duplicates.forks(scanned[1], scanned[2]).collect()
    assert {r.key for r in rows} >= {"experiments/a.py:alpha::lib/shared.py:shared", "experiments/b.py:beta::lib/shared.py:shared"}
    one = next(r for r in rows if r.key == "experiments/a.py:alpha::lib/shared.py:shared")
    assert one.channel == "small" and one.kind == "near_duplicate" and one.a_imports_b and not one.b_imports_a and not one.name_match and one.signature_match


def test_deadcode(spark, project, scanned):
    docs = files.texts(files.scan(spark, project, endings=files.DOCUMENTS))
    got = {r.path: r.status for r in deadcode.deadcode(scanned[2], files.texts(scanned[0]), docs, package="pkg").collect()}
    assert got == {
        "__init__.py": "PACKAGE", "lib/shared.py": "USED", "experiments/a.py": "USED", "experiments/b.py": "DEAD", "experiments/env.py": "DEAD", "experiments/gen.py": "DEAD", "experiments/dynamic.py": "DEAD",
        "experiments/late.py": "USED", "lib/plugin.py": "USED", "tools/extra.py": "USED", "tools/lonely.py": "DOC-ONLY", "tools/named.py": "USED", "tools/talk.py": "DEAD", "tools/broken.py": "PARSE-ERROR", "tests/test_x.py": "TEST",
    }
    quiet = spark.createDataFrame([("tools/lonely.py",)], "path string")
    assert "tools/lonely.py" not in {r.path for r in deadcode.deadcode(scanned[2], files.texts(scanned[0]), suppressed=quiet).collect()}


def test_deadcode_tells_what_refers(spark, project, scanned):
    docs = files.texts(files.scan(spark, project, endings=files.DOCUMENTS))
    got = {r.path: r for r in deadcode.deadcode(scanned[2], files.texts(scanned[0]), docs, package="pkg").collect()}
    assert got["lib/shared.py"].py_refs == ["experiments/a.py"] and got["lib/shared.py"].n_py_refs == 1 and got["lib/shared.py"].dynamic_edges == []
    late = got["experiments/late.py"]
    assert late.py_refs == ["experiments/dynamic.py"] and [(e.path, e.line > 0) for e in late.dynamic_edges] == [("experiments/dynamic.py", True)] and late.n_dynamic_edges == 1
    assert got["tools/named.py"].dynamic_refs == ["tools/talk.py"] and got["tools/named.py"].py_refs == []
    assert got["tools/lonely.py"].doc_refs == ["notes.md"] and got["tools/lonely.py"].n_doc_refs == 1
    assert (got["tools/talk.py"].n_py_refs, got["tools/talk.py"].n_dynamic_refs, got["tools/talk.py"].n_doc_refs) == (0, 0, 0)


FACT = "path string, kind string, value string, detail string, line int"


def test_deadcode_lists_are_cut_and_counted(spark):
    """Forty files import one, and one reaches another by a path from the folder that holds the package."""
    rows = [(f"m{i:02}.py", "import", "base", None, 1) for i in range(40)] + [(p, "other", "x", None, 1) for p in ("base.py", "tools/far.py", "a/b.py")] + [("a/b.py", "dynamic", "pkg/tools/far.py", "spec", 3)]
    facts = spark.createDataFrame(rows, FACT)
    texts = spark.createDataFrame([(r[0], "") for r in rows], "path string, text string").distinct()
    got = {r.path: r for r in deadcode.deadcode(facts, texts, package="pkg").collect()}
    assert got["base.py"].py_refs == [f"m{i:02}.py" for i in range(12)] and got["base.py"].n_py_refs == 40 and got["base.py"].status == "USED"
    assert [tuple(e) for e in got["tools/far.py"].dynamic_edges] == [("a/b.py", "spec", 3)] and got["tools/far.py"].status == "USED"
    assert {r.status for r in deadcode.deadcode(facts.where("path = 'tools/far.py' OR path = 'a/b.py'"), texts).where("path = 'tools/far.py'").collect()} == {"DEAD"}
    assert deadcode.deadcode(facts.where("false"), texts).count() == 0


def test_capabilities(scanned):
    got = {r.local: r for r in capabilities.overlaps(scanned[1]).collect()}
    assert got["experiments/b.py:read_table"].lib == "lib/shared.py:load_table" and got["experiments/b.py:read_table"].match == "doc" and got["experiments/b.py:read_table"].signature_match


def test_checklist(scanned):
    got = capabilities.checklist(scanned[1], "experiments/b.py").collect()
    told = [(r.local, r.mode, [(m.lib, m.signature_match, m.similarity) for m in r.matches]) for r in got]
    assert told == [
        ("experiments/b.py:beta", "doc", [("lib/shared.py:shared", True, 0.667)]),
        ("experiments/b.py:read_table", "doc", [("lib/shared.py:load_table", True, got[1].matches[0].similarity)]),
        ("experiments/b.py:beta", "none", []),
    ]
    assert all(capabilities.checklist(scanned[1], p).count() == 0 for p in ("lib/shared.py", "tests/test_x.py", "none.py"))


def test_contracts(scanned):
    symbols, facts = scanned[1], scanned[2]
    assert [(r.value, r.path) for r in contracts.env_written_not_read(facts).collect()] == [("LOST", "experiments/env.py")]
    assert [r.path for r in contracts.generation_path_without_env(facts).collect()] == ["experiments/gen.py"]
    assert [r.path for r in contracts.defensive_param_loosening(facts).collect()] == ["experiments/gen.py"]
    assert {r.qualname for r in contracts.forwarding_wrappers(symbols).collect()} == {"read_table", "_load", "load_table"}  # open(path).read() too: what is called needs no dotted name
    assert "nobody" in {r.qualname for r in contracts.unreferenced(symbols, facts).collect()}
    assert [r.path for r in contracts.cli_without_bootstrap(facts).collect()] == ["experiments/a.py"]
    assert [r.path for r in contracts.experiment_path_hacks(facts).collect()] == ["experiments/dynamic.py"]


def test_locks(spark, project, scanned):
    manifests = files.scan(spark, project, endings=(".json",))
    got = locks.locked_files(manifests, scanned[0]).collect()
    assert [(r.path, r.manifests) for r in got] == [("lib/shared.py", ["lock.json"])]
    assert [r.path for r in locks.for_package(locks.locked_files(manifests, scanned[0]), "lib").collect()] == ["shared.py"]


def test_sequence_gates():
    assert ratio(["a"] * 8, ["a"] * 10, 0.82) == 0.0  # the length gate is stricter than the ratio
    a, b = list("abcdefgh"), list("abcdefgx")
    assert ratio(a, b, 0.8) == SequenceMatcher(None, a, b, autojunk=False).ratio()
    assert covered(list("abcde"), list("abcde") + list("z" * 40), 5) == 0.0
    assert covered(list("abcde"), list("abcdez"), 5) == 1.0


def test_hardcoded_places_of_many_matches(spark):
    """Matches over several lines and many in one text: each is on the line where it begins, with the line's code; a text is read once."""
    text = "".join(f"x{i} = hashlib.sha256({i})\n" + "\n" * (i % 3) for i in range(20_000))
    spread = hardcoded.Pattern("spread", r"begin\s+end", "high")
    rows = [("many.py", text), ("two.py", "a\nbegin\n\nend begin end\r\nhashlib.sha256(1) hashlib.sha256(2)"), ("none.py", ""), ("null.py", None), ("tests/t.py", "hashlib.sha256(")]
    start = time.monotonic()
    got = hardcoded.hardcoded(spark.createDataFrame(rows, "path string, text string"), (*hardcoded.PATTERNS, spread)).select("path", "pattern", "line", "code").collect()
    assert time.monotonic() - start < 60
    want = [(i + 1, line) for i, line in enumerate(text.split("\n")) if line]
    assert sorted((r.line, r.code) for r in got if r.path == "many.py") == want
    assert sorted((r.pattern, r.line, r.code) for r in got if r.path != "many.py") == [("manual_sha256", 5, "hashlib.sha256(1) hashlib.sha256(2)")] * 2 + [("spread", 2, "begin"), ("spread", 4, "end begin end")]
