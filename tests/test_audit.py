"""A whole audit of a small project under git."""

import json
import subprocess

import pytest

from tracewell import audit, config
from tracewell.operators import lines
from tracewell.sources import git

from .test_regions import RISKY, TWIN
from .test_review import VERDICT, verdict
from .test_scanners import BODY


def test_audit_from_the_command_line(spark, tmp_path):
    root = tmp_path / "project"
    own = {
        "lib/shared.py": BODY.format(name="shared"), "experiments/a.py": BODY.format(name="alpha"), "experiments/b.py": BODY.format(name="beta"), "experiments/t1.py": TWIN.format(name="left", n=2),
        "experiments/t2.py": TWIN.format(name="right", n=3), "experiments/r1.py": RISKY.format(name="s"), "experiments/r2.py": RISKY.format(name="e"), "__init__.py": "", "experiments/env.py": "import os\nos.environ['LOST'] = '1'\n",
    }
    for path, text in own.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    run = lambda *a: subprocess.run(["git", "-C", str(root), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True)
    run("init", "-q")
    run("add", "-A")
    run("commit", "-qm", "one")
    (root / "experiments/env.py").write_text("import os\nos.environ['LOST'] = '2'\n")
    (root / "experiments/new.py").write_text("x = 1\n")
    assert git.provenance(str(root))["status"] == "dirty" and git.provenance(str(tmp_path / "none"))["status"] == "unavailable"
    assert [r.path for r in git.changed_files(spark, str(root), "HEAD").collect()] == ["experiments/env.py", "experiments/new.py"]
    assert {r.path: bytes(r.content).decode() for r in git.tree(spark, str(root), "HEAD").collect()} == own
    quiet = tmp_path / "quiet.json"
    quiet.write_text(json.dumps({"deadcode": ["DEAD/experiments/r1.py", {"path": "experiments/gone.py", "id": "DEAD/experiments/gone.py"}], "contracts": {"env": [{"key": "experiments/env.py:1:environ"}]}}))
    code = audit.main([str(root), "--json", str(tmp_path / "r.json"), "--markdown", str(tmp_path / "r.md"), "--suppress", str(quiet), "--snippets", str(tmp_path / "code")])
    found = json.loads((tmp_path / "r.json").read_text())
    assert code == 0 and found["complete"]
    targets = {(c["scanner"], c["target_id"]) for c in found["candidates"]}
    assert ("deadcode", "DEAD/experiments/r2.py") in targets and ("deadcode", "DEAD/experiments/r1.py") not in targets
    assert any(s == "contracts" and t.startswith("env_written_not_read/") for s, t in targets)
    assert {"duplicates", "forks", "regions", "deadcode", "contracts"} <= set(found["scanners"])
    assert found["issues"]["corroborated"] >= 1  # the twins are duplicates as well
    named = found["corroborated"]
    assert len(named) == min(20, found["issues"]["corroborated"]) and named == sorted(named, key=lambda n: n["issue_id"]) and all(n["channels"] == ["duplicates", "regions"] and len(n["members"]) == min(3, n["n_members"]) for n in named)
    told = (tmp_path / "r.md").read_text()
    assert "| issue | channels | signals | members |" in told and f"`{named[0]['issue_id']}`" in told
    assert "## duplicates" in told and "status=DEAD py_refs=" in told and "now at line 2" in told
    assert {c["cohort"] for c in found["candidates"] if c["scanner"] == "regions"} <= {"high", "medium", "low"} and {c["cohort"] for c in found["candidates"] if c["scanner"] == "deadcode"} == {"low"}
    gone = {(g["scanner"], g["target_id"]): (g["reason"], g["moved_to"]) for g in found["stale_suppressions"] if g["reason"] != "no such finding"}
    assert gone == {("deadcode", "experiments/gone.py"): ("file missing: experiments/gone.py", None), ("contracts/env", "experiments/env.py:1:environ"): ("line 1 no longer defines `environ`", 2)}
    assert all(c["locks"] == [] for c in found["candidates"])
    # The same project again with a lock and one file less: what changed is told, but not once the settings differ.
    (root / "experiments/r2.py").unlink()
    (root / "lock.json").write_text(json.dumps({"files": {"lib/shared.py": "b" * 64}}))
    again = [str(root), "--json", str(tmp_path / "r.json"), "--markdown", str(tmp_path / "r.md"), "--suppress", str(quiet), "--previous", str(tmp_path / "r.json")]
    assert audit.main(again) == 0
    second = json.loads((tmp_path / "r.json").read_text())
    change = {c["scanner"]: c for c in second["previous_run"]["scanners"]}
    assert second["previous_run"]["reason"] is None and change["deadcode"]["gone"] == 1 and change["deadcode"]["new"] == 0 and "r2.py" in change["deadcode"]["first_gone"][0]
    assert any(k == {"path": "lib/shared.py", "manifests": ["lock.json"]} for c in second["candidates"] for k in c["locks"])
    told = (tmp_path / "r.md").read_text()
    assert "### gone of deadcode (1)" in told and "locked: lib/shared.py by lock.json" in told
    quiet.write_text("{}")
    before = json.loads((tmp_path / "r.json").read_text())
    assert audit.previous_run(spark, str(tmp_path / "r.json"), before | {"audit_config_hash": config.digest({}, {}, str(quiet))}, None) == {"reason": "audit_config_hash", "scanners": []}
    assert audit.previous_run(spark, str(tmp_path / "none.json"), before, None) is None
    code = spark.read.json(str(tmp_path / "code")).where("scanner = 'duplicates' AND error IS NULL").collect()
    assert code and all(c.code.startswith(f"L{c.start_line}: def ") for c in code)


def test_digests(tmp_path):
    quiet = tmp_path / "q.json"
    quiet.write_text("{}")
    one = config.digest({"audit": {"package": "a", "suppress": "x"}}, {}, str(quiet))
    assert one == config.digest({"audit": {"package": "a", "suppress": "elsewhere"}}, {}, str(quiet)) != config.digest({"audit": {"package": "b"}}, {}, str(quiet))
    quiet.write_text('{"forks": []}')
    assert config.digest({"audit": {"package": "a"}}, {}, str(quiet)) != one and len(config.engine_digest()) == 64


def test_settings(tmp_path):
    assert config.load(str(tmp_path)) == {}
    put = (tmp_path / "tracewell.toml").write_text
    put('[audit]\npackage = "src"\n[[hardcoded.patterns]]\nname = "x"\nregex = "y"\n')
    read = config.load(str(tmp_path))
    assert config.pick("", read, "audit", "package", "d") == "src" and config.pick("cli", read, "audit", "package", "d") == "cli" and config.pick(None, read, "audit", "suppress", "d") == "d"
    assert [(p.name, p.severity) for p in config.patterns(read)] == [("x", "medium")] and len(config.patterns({})) == 3
    for bad in ("[nothing]\nx = 1\n", "[audit]\npackage = 1\n", "[contracts]\nsensitive_names = [1]\n", "[[hardcoded.patterns]]\nname = 'x'\n"):
        put(bad)
        with pytest.raises(ValueError):
            config.load(str(tmp_path))


def test_registry(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"schema_version": 1, "_notes": "n", "forks": ["a"], "deadcode": [{"id": "b"}, {"reason": "none"}], "contracts": {"same_name": [{"key": "c"}]}}))
    known = audit.suppressed(spark, str(path))
    assert sorted(map(tuple, known.collect())) == [("contracts", "same_name/c"), ("deadcode", "b"), ("forks", "a")]
    found = spark.createDataFrame([("forks", "a"), ("deadcode", "z")], "scanner string, target_id string")
    assert sorted(map(tuple, audit.stale(known, found).collect())) == [("contracts", "same_name/c"), ("deadcode", "b")]
    verdicts = spark.createDataFrame([verdict("t", "false_positive", action="none", reason="is fine"), verdict("u")], VERDICT)
    nothing = spark.createDataFrame([], "scanner string, target_id string, detail string")
    assert audit.exported(verdicts, "2026-01-01", "me", nothing) == {"deadcode": [{"target_id": "t", "reason": "is fine", "date": "2026-01-01", "owner": "me"}]}


def test_exported_registry_names_places(spark, tmp_path):
    """What is exported suppresses the same findings when it is read, and says where each stands; later the places are probed."""
    rows = [
        ("deadcode", "DEAD/a.py", {"path": "a.py", "status": "DEAD"}, {"path": "a.py"}), ("duplicates", "d1", {"id": "d1"}, {}), ("forks", "fork/x", {"key": "a.py:f::b.py:g"}, {"key": "a.py:f::b.py:g"}),
        ("capabilities", "c1", {"local": "b.py:C.g", "lib": "lib/x.py:g"}, {"key": "b.py:g"}), ("contracts", "env_written_not_read/LOST:a.py:2", {"value": "LOST", "path": "a.py", "line": 2}, {"key": "a.py:2:LOST"}),
        ("contracts", "forwarding_wrappers/w", {"path": "b.py", "qualname": "g"}, {"key": "b.py:g"}), ("contracts", "same_name/n", {"name": "n", "paths": ["a.py"]}, {}), ("hardcoded", "hard/p/a.py:1", {"path": "a.py", "line": 1}, {"path": "a.py"}),
    ]
    found = spark.createDataFrame([(s, t, json.dumps(d)) for s, t, d, _ in rows], "scanner string, target_id string, detail string")
    verdicts = spark.createDataFrame([(s, *verdict(t, "false_positive", action="none", reason="ok")[1:]) for s, t, _, _ in rows] + [verdict("true one")], VERDICT)
    out = audit.exported(verdicts, "2026-01-01", "me", found)
    flat = {(s if isinstance(own, list) else f"{s}/{c}", e["target_id"]): e for s, own in out.items() for c, es in (own.items() if isinstance(own, dict) else [("", own)]) for e in es}
    meta = {"reason": "ok", "date": "2026-01-01", "owner": "me"}
    assert flat == {(f"contracts/{t.split('/')[0]}" if s == "contracts" else s, t): {"target_id": t} | where | meta for s, t, _, where in rows}
    path = tmp_path / "r.json"
    path.write_text(json.dumps(out))
    assert sorted(map(tuple, audit.suppressed(spark, str(path)).collect())) == sorted((s, t) for s, t, _, _ in rows)
    places = lines.entry_places(audit.registered(spark, str(path)))
    texts = spark.createDataFrame([("a.py", "import os\nos.environ['LOST'] = '1'\n"), ("b.py", "def g():\n    pass\n")], "path string, text string")
    assert lines.stale_places(places, texts).count() == 0
    moved = spark.createDataFrame([("a.py", "\nimport os\nos.environ['LOST'] = '1'\n")], "path string, text string")
    got = {(r.section, r.key): (r.reason, r.moved_to) for r in lines.stale_places(places, moved).collect()}
    assert got[("contracts/env_written_not_read", "a.py:2:LOST")] == ("line 2 no longer defines `LOST`", 3) and got[("capabilities", "b.py:g")] == ("file missing: b.py", None)
