"""Review state from files that arrive in batches, with restarts."""

import json

import pytest

from tracewell.sources import keyed
from tracewell.streaming import reviews

FOUND = "scanner string, target_id string, evidence_hash string"


def said(target, at, disposition="false_positive", evidence="e1", **more):
    action = {"false_positive": "none", "true_finding": "delete_dead_code"}.get(disposition)
    checks = ["re_audit"] if disposition == "true_finding" else None
    return {"scanner": "deadcode", "target_id": target, "evidence_hash": evidence, "reviewed_at": f"2026-01-{at:02}T00:00:00Z", "disposition": disposition, "confidence": 0.9, "reason": f"r{at}", "reason_codes": ["OTHER"], "recommended_action": action, "required_verification": checks} | more


FILES = [
    [said("a", 5), said("b", 1), said("x", 1, confidence=9.0)],
    [said("a", 3, "true_finding"), said("b", 2, "true_finding"), said("c", 1, "skip")],
    [said("b", 2, "true_finding", reason="again"), said("c", 4), said("d", 1, evidence="old")],
]


def put(folder, n):
    folder.mkdir(exist_ok=True)
    (folder / f"{n}.json").write_text("".join(json.dumps(v) + "\n" for v in FILES[n]))


def state(table):
    return sorted((r.target_id, r.disposition, r.reason, r.evidence_hash) for r in table.read().collect())


WANT = [("a", "false_positive", "r5", "e1"), ("b", "true_finding", "r2", "e1"), ("c", "false_positive", "r4", "e1"), ("d", "false_positive", "r1", "old")]


def run(spark, tmp_path, name, **more):
    table = keyed.verdicts(spark, str(tmp_path / name / "table"))
    reviews.follow(spark, str(tmp_path / "in"), table, str(tmp_path / name / "checkpoint"), str(tmp_path / name / "rejected"), **more).awaitTermination()
    return table


def test_batches_and_restarts_give_what_one_batch_gives(spark, tmp_path):
    put(tmp_path / "in", 2)
    first = run(spark, tmp_path, "many")
    for n in (0, 1):
        put(tmp_path / "in", n)
    many = run(spark, tmp_path, "many", files_per_batch=1)  # goes on from the checkpoint
    one = run(spark, tmp_path, "one")
    assert state(many) == state(one) == [(t, d, "r2" if t == "b" else r, e) for t, d, r, e in WANT] and first.path == many.path
    broken = [r.target_id for r in spark.read.option("recursiveFileLookup", True).json(str(tmp_path / "many" / "rejected")).collect()]
    assert broken == ["x"]
    before = many.states()
    assert state(run(spark, tmp_path, "many")) == state(one) and many.states() == before  # nothing new, nothing done


def test_a_batch_that_comes_again(spark, tmp_path):
    table = keyed.verdicts(spark, str(tmp_path / "t"))
    batch = spark.read.schema(keyed.VERDICTS).json(spark.sparkContext.parallelize([json.dumps(v) for v in FILES[0]]))
    assert reviews.merge(table, batch, "c:0") == reviews.merge(table, batch, "c:0") == 1


def test_verdicts_hold_for_their_evidence(spark, tmp_path):
    for n in range(3):
        put(tmp_path / "in", n)
    table = run(spark, tmp_path, "s")
    found = spark.createDataFrame([("deadcode", "a", "e1"), ("deadcode", "d", "new"), ("deadcode", "n", "e1"), ("deadcode", "c", "e1")], FOUND)
    assert {r.target_id: r.state for r in reviews.settled(table, found).collect()} == {"a": "current", "b": "gone", "c": "current", "d": "changed"}
    assert sorted(r.target_id for r in reviews.waiting(table, found).collect()) == ["d", "n"]
    reviews.settle(table, found)
    assert [r[0] for r in state(table)] == ["a", "c"]


def test_command_line(spark, tmp_path, capsys):
    for n in range(3):
        put(tmp_path / "in", n)
    report = tmp_path / "report.json"
    report.write_text(json.dumps({"candidates": [{"scanner": "deadcode", "target_id": t, "display": t, "risk": None, "evidence_hash": "e1"} for t in "abn"]}))
    own = [str(report), str(tmp_path / "in"), str(tmp_path / "state")]
    assert reviews.main([*own, "--check"]) == 1 and capsys.readouterr().out.split() == ["deadcode:", "a", "deadcode:", "b", "deadcode:", "n"]
    assert reviews.main([*own, "--export", str(tmp_path / "ignore.json"), "--day", "2026-01-01", "--owner", "me"]) == 0 and capsys.readouterr().out.split() == ["deadcode:", "n"]
    assert [e["target_id"] for e in json.loads((tmp_path / "ignore.json").read_text())["deadcode"]] == ["a"]
    with pytest.raises(SystemExit):
        reviews.main([str(tmp_path / "none.json"), *own[1:]])
