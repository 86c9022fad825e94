"""Digests of trees, what changed between two of them, and work that isn't done again."""

import random

from pyspark.sql import functions as F

from tracewell.operators import review
from tracewell.sources import trees


def frame(spark, own):
    return spark.createDataFrame([(p, c.encode()) for p, c in own.items()], "path string, content binary")


def test_tree(spark):
    own = {"a.py": "1", "lib/b.py": "2", "lib/deep/er/c.py": "3", "x/d.py": "2"}
    rows = {r.path: r for r in trees.tree(trees.file_digests(frame(spark, own))).collect()}
    assert set(rows) == {*own, "", "lib", "lib/deep", "lib/deep/er", "x"}
    assert (rows[""].files, rows[""].size, rows[""].parent, rows["lib"].parent, rows["lib/deep/er"].parent, rows["lib"].files) == (4, 4, None, "", "lib/deep", 2)
    same = {r.path: r.digest for r in trees.tree(trees.file_digests(frame(spark, dict(reversed(own.items()))).repartition(3))).collect()}
    assert same == {p: r.digest for p, r in rows.items()}
    other = {r.path: r.digest for r in trees.tree(trees.file_digests(frame(spark, own | {"lib/deep/er/c.py": "4"}))).collect()}
    assert {p for p in same if same[p] != other[p]} == {"", "lib", "lib/deep", "lib/deep/er", "lib/deep/er/c.py"}
    renamed = {("lib/deep/er/z.py" if p.endswith("c.py") else p): c for p, c in own.items()}
    assert trees.tree(trees.file_digests(frame(spark, renamed))).where("path = ''").first().digest != same[""]
    assert trees.tree(trees.file_digests(frame(spark, own).where("false"))).count() == 0


def test_changes(spark):
    r = random.Random(1)
    paths = ["/".join(r.choice("abc") * r.randrange(1, 3) for _ in range(r.randrange(1, 4))) + f"/{i}.py" for i in range(60)] + [f"{i}.py" for i in range(5)]
    before = {p: str(r.randrange(9)) for p in paths}
    now = {p: (c if r.random() < 0.8 else c + "!") for p, c in before.items() if r.random() < 0.9} | {"new/one/file.py": "1", "a/new.py": "2"}
    want = {p: "new" if p not in before else "gone" if p not in now else "changed" for p in {*before, *now} if before.get(p) != now.get(p)}
    a, b = (trees.tree(trees.file_digests(frame(spark, x))) for x in (before, now))
    assert {x.path: x.change for x in trees.changes(a, b).collect()} == want and len(want) > 10
    assert trees.changes(a, a).count() == 0
    none = trees.tree(trees.file_digests(frame(spark, before).where("false")))
    assert {x.change for x in trees.changes(none, b).collect()} == {"new"} and trees.changes(b, none).count() == len(now)


def test_only_new_digests_are_parsed(spark):
    before, now = {"a.py": "1", "b.py": "2", "c.py": "3"}, {"a.py": "1", "b.py": "5", "d.py": "1"}
    parsed = []

    def parse(files):
        parsed.append(sorted(r.path for r in files.collect()))
        return files.select("path", F.decode("content", "utf-8").alias("said"))

    old = frame(spark, before)
    made = parse(old)
    out = trees.renewed(frame(spark, now), trees.file_digests(frame(spark, now)), trees.file_digests(old), made, parse)
    assert sorted(map(tuple, out.collect())) == sorted(now.items()) and parsed[1] == ["b.py", "d.py"]


def test_a_changed_basis_fails_the_gate(spark):
    source, docs = {"a.py": "1"}, {"r.md": "x"}
    was = trees.basis({"source": frame(spark, source), "documents": frame(spark, docs), "tex": frame(spark, docs).where("false")})
    assert {r.scope: r.files for r in was.collect()} == {"source": 1, "documents": 1}
    assert trees.mismatches(was, was) == ()
    now = trees.basis({"source": frame(spark, {"a.py": "2"}), "documents": frame(spark, docs), "tex": frame(spark, docs)})
    assert trees.mismatches(was, now) == ("source has changed", "tex has changed")
    found = spark.createDataFrame([], "scanner string, target_id string, evidence_hash string, risk string, paths array<string>")
    verdicts = spark.createDataFrame([], "scanner string, target_id string, evidence_hash string, disposition string, confidence double, reason string, reason_codes array<string>, recommended_action string, reuse_target string, required_verification array<string>")
    assert {r.rule for r in review.failures(verdicts, found, tests="passed", mismatches=trees.mismatches(was, now)).collect()} == {"source has changed", "tex has changed"}
