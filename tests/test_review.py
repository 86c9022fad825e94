"""Verdicts, the gate, TeX prose and rounding-sensitive samples."""

from tracewell.functions.ids import evidence_hash
from tracewell.operators import findings, references, review, scoring
from tracewell.sources import tex

VERDICT = "scanner string, target_id string, evidence_hash string, disposition string, confidence double, reason string, reason_codes array<string>, recommended_action string, reuse_target string, required_verification array<string>"
FOUND = "scanner string, target_id string, display string, risk string, paths array<string>, detail string, evidence_hash string"


def verdict(target, disposition="true_finding", confidence=0.9, reason="r", codes=(), action="delete_dead_code", reuse=None, gates=("re_audit",), h="h"):
    return ("deadcode", target, h, disposition, confidence, reason, list(codes), action, reuse, list(gates))


def test_protocol(spark):
    rows = [
        verdict("ok"), verdict("fp", "false_positive", action="none"), verdict("d", "maybe"), verdict("c", confidence=1.5), verdict("r", reason=" "), verdict("k", codes=["NOPE"]),
        verdict("a", action="explode"), verdict("g", gates=["re_audit", "x"]), verdict("n", action="none"), verdict("e", gates=[]), verdict("f", "false_positive"), verdict("u", action="reuse_existing"),
    ]
    got = {r.target_id: r.invalid_reason for r in review.invalid_reason(spark.createDataFrame(rows, VERDICT)).collect()}
    assert got["ok"] is None and got["fp"] is None
    assert [got[k] for k in "dcrkag"] == ["disposition", "confidence", "reason", "reason_codes", "recommended_action", "required_verification"]
    assert got["n"] == "a finding needs an action" and got["e"] == "a finding needs re_audit" and got["f"] == "a false positive has no action" and got["u"] == "reuse_existing needs a target"


def test_gate(spark):
    now = spark.createDataFrame([("deadcode", "a", "", "high", ["lib/a.py"], "", "h"), ("deadcode", "b", "", "high", ["lib/b.py"], "", "new"), ("forks", "c", "", None, [], "", "x"), ("regions", "d", "", "medium", ["tools/d.py"], "", "y"), ("regions", "e", "", "medium", [], "", "z")], FOUND)
    before = now.where("target_id IN ('a', 'b', 'c')")
    verdicts = spark.createDataFrame([verdict("a"), verdict("b"), verdict("gone"), verdict("x", "maybe")], VERDICT)
    got = sorted((r.rule, r.target_id) for r in review.failures(verdicts, now, before, True, "lib", "passed").collect())
    assert got == [("evidence unchanged", "a"), ("invalid verdict", "x"), ("new medium", "e"), ("still present", "a"), ("still present", "b")]
    rules = {r.rule for r in review.failures(verdicts, now, before, False, None, "not_run", ("tree changed",)).collect()}
    assert {"not comparable", "no test evidence", "tree changed"} <= rules and not any(r.startswith("new") for r in rules)
    clean = review.failures(spark.createDataFrame([], VERDICT), before, before, True, None, "passed")
    assert clean.count() == 0
    assert [r.target_id for r in review.pending(now, verdicts).orderBy("target_id").collect()] == ["b", "c", "d", "e"]
    assert review.comparable({"package": "a", "profile": 1}, {"package": "a", "profile": 2}) == "profile"
    assert tuple(review.mutation_recall(now, before).first()) == (3, 3, 1.0)


def test_changes(spark):
    row = "scanner string, target_id string, display string"
    before = [("forks", f"t{i:03}", "same") for i in range(40)] + [("regions", "r", "old name"), ("regions", "r", "old name"), ("gone", None, "null")]
    now = [("forks", f"t{i:03}", "same") for i in range(20, 61)] + [("regions", "r", "new name"), ("style", "s", "x")]
    got = {r.scanner: r for r in review.changes(spark.createDataFrame(before, row), spark.createDataFrame(now, row), 15).collect()}
    assert [tuple(got[s])[1:5] for s in ("forks", "regions", "style", "gone")] == [(40, 41, 21, 20), (1, 1, 1, 1), (0, 1, 1, 0), (1, 0, 0, 1)]
    assert got["forks"].first_new == ["same"] * 15 and got["regions"].first_new == ["new name"] and got["regions"].first_gone == ["old name"] and got["gone"].first_gone == ["null"]
    nothing = spark.createDataFrame([], row)
    assert review.changes(nothing, nothing).count() == 0


def test_first_references(spark):
    rows = [(None, 3), (None, 1), (None, 1), ("a", None), ("a", 9), ("a", 5), ("a", 7)]
    got = {r.k: (r.n, [x.v for x in r.refs]) for r in references.first_references(spark.createDataFrame(rows, "k string, v int"), ["k"], ["v"], 2).collect()}
    assert got == {None: (2, [1, 3]), "a": (4, [None, 5])}


def test_locks_on_findings(spark):
    found = spark.createDataFrame([("s", "t", ["b.py", "a.py", "b.py"]), ("s", "u", ["c.py"]), ("s", "v", None), ("s", "w", [])], "scanner string, target_id string, paths array<string>")
    locked = spark.createDataFrame([("a.py", ["m.json"]), ("b.py", ["m.json", "n.json"])], "path string, manifests array<string>")
    got = {r.target_id: [(k.path, k.manifests) for k in r.locks] for r in findings.with_locks(found, locked).collect()}
    assert got == {"t": [("a.py", ["m.json"]), ("b.py", ["m.json", "n.json"])], "u": [], "v": [], "w": []}


def test_hash_is_canonical():
    assert evidence_hash("s", "t", {"b": 1, "a": "é"}) == evidence_hash("s", "t", {"a": "é", "b": 1})
    assert evidence_hash("s", "t", {"a": 1}) != evidence_hash("s", "t", {"a": 2})


def test_tex(spark):
    source = "\\documentclass{x}\n\\begin{document}\n\\section{One {two} $a^{R}$}\nPlain \\emph{words} here; costs $5 + x$; more~words. % note\nTwo -- three --- four.\n$1 \\pm 2$ and {\\pm} and \\!\\pm\\!\n\\end{document}\n"
    text, before = tex.prose(source)
    assert before == 3 and "One" not in text and "note" not in text and "words here; costs" in text and "[MATH]" in text and "EMDASH" in text and "-" not in text
    docs = tex.documents(spark.createDataFrame([("a.tex", source.encode())], "path string, content binary"))
    assert docs.first().text.count("[MATH]") == 0
    assert [r.line for r in tex.bare_pm(docs).collect()] == [6]
