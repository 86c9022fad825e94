"""Tables that several writers change, and verdict files written by tasks."""

import json
import threading

import pytest
from pyspark.sql import functions as F

from tracewell.sources import keyed, records, verdict_sink

SCHEMA = "k string, n long, said string"


@pytest.fixture
def counts(spark, tmp_path):
    return keyed.KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["k"])


def rows(t):
    return sorted(map(tuple, t.read().collect()))


def test_upsert_and_first(spark, counts):
    frame = lambda *x: spark.createDataFrame(list(x), SCHEMA)
    assert rows(counts) == [] and counts.states() == []
    assert counts.upsert(frame(("a", 1, "x"), ("b", 1, None))) == 1
    assert counts.upsert(frame(("a", 2, "y"), ("a", 1, "z"), ("c", 3, "x"))) == 2
    assert rows(counts) == [("a", 2, "y"), ("b", 1, None), ("c", 3, "x")]
    assert counts.add(frame(("a", 9, "late"), ("d", 4, "new"))) == 3
    assert rows(counts) == [("a", 2, "y"), ("b", 1, None), ("c", 3, "x"), ("d", 4, "new")]
    assert sorted(map(tuple, counts.read(1).collect())) == [("a", 1, "x"), ("b", 1, None)]


def test_a_change_that_comes_again_does_nothing(spark, counts):
    for n in (1, 2):
        counts.upsert(spark.createDataFrame([("a", n, "x")], SCHEMA), note="batch 1")
    assert rows(counts) == [("a", 1, "x")] and len(counts.states()) == 1


def test_a_task_that_dies_half_way_leaves_nothing(spark, counts, tmp_path):
    counts.upsert(spark.createDataFrame([("a", 1, "x")], SCHEMA))
    broken = spark.range(0, 40, 1, 4).select(F.col("id").cast("string").alias("k"), "id", F.lit("y").alias("said")).toDF("k", "n", "said")
    broken = broken.withColumn("n", F.when(F.col("n") == 35, F.raise_error(F.lit("dies"))).otherwise(F.col("n")))
    with pytest.raises(Exception, match="dies"):
        counts.upsert(broken)
    assert rows(counts) == [("a", 1, "x")]
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("state-")]) == 1


def test_two_writers_lose_nothing(spark, counts):
    """Each merges into a state that the other changes meanwhile."""
    failed, gate = [], threading.Barrier(4)

    def write(w):
        try:
            gate.wait()
            for i in range(2):
                counts.upsert(spark.createDataFrame([(f"{w}.{i}", w, "x"), ("shared", w, "x")], SCHEMA))
        except Exception as e:  # told below
            failed.append(e)

    threads = [threading.Thread(target=write, args=(w,)) for w in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not failed and {r[0] for r in rows(counts)} == {f"{w}.{i}" for w in range(4) for i in range(2)} | {"shared"}
    assert [s[0] for s in counts.states()] == list(range(1, 9))


def verdict(case, **more):
    return {"case_hash": case * 64, "scanner": "deadcode", "target_id": f"t{case}", "finding_evidence_hash": "e" * 64, "disposition": "false_positive", "confidence": 0.9, "reason": "is used", "reason_codes": ["OTHER"], "recommended_action": "none", "reuse_target": None, "required_verification": None} | more


def frame(spark, *found):
    schema = verdict_sink.VerdictFiles({}).schema()
    return spark.createDataFrame([tuple(f[c.split()[0]] for c in schema.split(", ")) for f in found], schema)


def test_verdict_files(spark, tmp_path):
    spark.dataSource.register(verdict_sink.VerdictFiles)
    save = lambda df: df.write.format("verdict_files").mode("append").save(str(tmp_path))
    save(frame(spark, verdict("a"), verdict("b", confidence=7.0)).repartition(2))
    got = {r.target_id: r for r in records.verdict_files(spark, str(tmp_path)).collect()}
    assert got["ta"].invalid_reason is None and got["ta"].case_hash == "a" * 64 and got["ta"].reason_codes == ["OTHER"] and got["tb"].invalid_reason == "confidence"
    save(frame(spark, verdict("b", confidence=0.5), verdict("c")))
    assert {r.target_id: r.confidence for r in records.verdict_files(spark, str(tmp_path)).collect()} == {"ta": 0.9, "tb": 0.5, "tc": 0.9}
    assert json.loads((tmp_path / ("c" * 64 + ".json")).read_text())["verdict"]["disposition"] == "false_positive"
    # A task that dies takes its whole job with it.
    with pytest.raises(Exception, match="not a hash"):
        save(frame(spark, verdict("a", confidence=0.1), verdict("d"), verdict("../x")).repartition(3))
    assert sorted(p.name[0] for p in tmp_path.glob("*.json")) == ["a", "b", "c"] and not list(tmp_path.glob("_staging/*"))
    assert json.loads((tmp_path / ("a" * 64 + ".json")).read_text())["verdict"]["confidence"] == 0.9


def test_a_half_moved_job_is_finished(spark, tmp_path, monkeypatch):
    writer = verdict_sink.VerdictWriter(str(tmp_path))
    from pyspark.sql import Row

    message = writer.write(iter([Row(**verdict("a")), Row(**verdict("b")), Row(**verdict("a", confidence=0.1))]))
    moved, real = [], verdict_sink.os.replace

    def dies(a, b):
        if len(moved) == 2:  # the list, and one file
            raise OSError("killed")
        moved.append(b)
        real(a, b)

    monkeypatch.setattr(verdict_sink.os, "replace", dies)
    with pytest.raises(OSError):
        writer.commit([message, None])
    monkeypatch.setattr(verdict_sink.os, "replace", real)
    assert len(list(tmp_path.glob("*.json"))) == 1
    assert verdict_sink.recover(str(tmp_path)) == 1 and verdict_sink.recover(str(tmp_path)) == 0
    assert sorted(p.name[0] for p in tmp_path.glob("*.json")) == ["a", "b"] and json.loads((tmp_path / ("a" * 64 + ".json")).read_text())["verdict"]["confidence"] == 0.1
    # One that was never committed doesn't show.
    verdict_sink.VerdictWriter(str(tmp_path)).write(iter([Row(**verdict("c"))]))
    assert verdict_sink.recover(str(tmp_path)) == 0 and len(list(tmp_path.glob("*.json"))) == 2
