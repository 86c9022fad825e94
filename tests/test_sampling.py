"""Numbers without one task, even and stride samples, seats, gold and review samples, against plain Python."""

import math
import random

from pyspark.sql import functions as F

from tracewell.operators import sampling, scoring


def test_numbers(spark):
    r = random.Random(1)
    rows = [(r.choice(["hot"] * 8 + ["a", "b", None]), r.randrange(50), i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(5)
    for by, order in ((["g"], ["x", "-i"]), ([], ["-x", "i"])):
        out = sampling.numbered(df, by, order)
        assert out.columns == ["g", "x", "i", "_i", "_n"]
        key = {"x": lambda t: t[1], "-x": lambda t: -t[1], "i": lambda t: t[2], "-i": lambda t: -t[2]}
        groups: dict = {}
        for t in sorted(rows, key=lambda t: [key[o](t) for o in order]):
            groups.setdefault(t[0] if by else 0, []).append(t)
        want = {t: (n, len(g)) for g in groups.values() for n, t in enumerate(g)}
        assert {(r.g, r.x, r.i): (r["_i"], r["_n"]) for r in out.collect()} == want
    assert sampling.numbered(df.where("false"), ["g"], ["i"]).count() == 0


def test_even_and_stride(spark):
    cases = [(n, cap) for n in (1, 2, 5, 7, 10, 11, 96, 100) for cap in (1, 2, 3, 4, 7, 8, 10, 99)]
    rows = spark.createDataFrame([(n, cap, i) for n, cap in cases for i in range(n)], "n long, cap int, i long")
    got = rows.select("*", sampling.evenly(F.col("i"), F.col("n"), F.col("cap")).alias("e"), sampling.by_stride(F.col("i"), F.col("n"), F.col("cap")).alias("s")).collect()
    for n, cap in cases:
        even = set(range(n)) if n <= cap else {int(round(j * (n / cap))) for j in range(cap)}
        stride = set(range(n)) if n <= cap else {math.floor(j * (n / cap)) for j in range(cap)}
        own = [r for r in got if (r.n, r.cap) == (n, cap)]
        assert {r.i for r in own if r.e} == even and {r.i for r in own if r.s} == stride


def plain_seats(counts, total, least):
    out, free, every = {k: least for k in counts}, max(0, total - least * len(counts)), sum(counts.values())
    exact = {k: n / every * free for k, n in counts.items()}
    left = free - sum(map(math.floor, exact.values()))
    for i, k in enumerate(sorted(counts, key=lambda k: (round(exact[k] - math.floor(exact[k]), 9), k), reverse=True)):
        out[k] += math.floor(exact[k]) + (i < left)
    return out


def test_seats(spark):
    r = random.Random(2)
    groups = {g: ({f"k{i}": r.randrange(1, 60) for i in range(r.randrange(1, 7))}, r.randrange(0, 40)) for g in "abcdefgh"}
    counts = spark.createDataFrame([(g, k, n, t) for g, (c, t) in groups.items() for k, n in c.items()], "g string, k string, n int, t int")
    for least in (0, 1):
        got = {(x.g, x.k): x.quota for x in sampling.seats(counts, ["g"], "k", "n", F.col("t"), least).collect()}
        assert got == {(g, k): q for g, (c, t) in groups.items() for k, q in plain_seats(c, t, least).items()}
    one = counts.where("g = 'a'").select("k", "n")
    assert {x.k: x.quota for x in sampling.seats(one, [], "k", "n", 17).collect()} == plain_seats(groups["a"][0], 17, 0)
    assert sampling.seats(one.where("false"), [], "k", "n", 17).count() == 0


def test_samples(spark):
    label = lambda p, s, i, true, reason="r": (p, s, f"t{i:03}", "true_finding" if true else "false_positive", None, reason)
    rows = [label(p, s, i, i % 50 == 0, "an overload stub" if i == 3 else "r") for p, s, n in (("p", "forks", 120), ("p", "style", 3), ("q", "forks", 60)) for i in range(n)]
    labels = spark.createDataFrame(rows, "project string, scanner string, target_id string, label string, issue_id string, reason string")
    gold = sampling.gold_sample(labels, 40).collect()
    true = [x for x in rows if x[3] == "true_finding"]
    quota = plain_seats({"p": 119, "q": 58}, 40 - len(true), 0)
    quotas = {("p", s): n for s, n in plain_seats({"forks": 117, "style": 2}, quota["p"], 1).items()} | {("q", "forks"): quota["q"]}
    want = {x[:3] for x in true}
    for (p, s), n in quotas.items():
        own = sorted(x[:3] for x in rows if x[0] == p and x[1] == s and x[3] != "true_finding")
        want |= {own[math.floor(j * (len(own) / n))] for j in range(n)} if len(own) > n else set(own)
    assert {(g.project, g.scanner, g.target_id) for g in gold} == want and len(gold) == len(want)
    assert all(g.boundary == ("overload" in g.reason and g.gold_label != "true_finding") for g in gold)

    now = labels.select("project", "scanner", "target_id", "label", F.concat(F.lit("h"), "target_id").alias("evidence_hash"))
    was = [("p", "forks", "t000", "true_finding", "ht000", True, ["me"], 3, "kept"), ("p", "forks", "t050", "true_finding", "other", True, ["me"], 3, "stale"), ("p", "forks", "gone", "false_positive", "x", True, ["me"], 2, "verified"), ("p", "forks", "gone2", "false_positive", "x", False, [], 2, "dropped")]
    existing = spark.createDataFrame(was, "project string, scanner string, target_id string, label string, evidence_hash string, human_verified boolean, reviewers array<string>, ground_truth_version int, note string")
    entries, stale = sampling.corpus_sample(now, existing, 40)
    got = {(e.project, e.scanner, e.target_id): e for e in entries.collect()}
    assert [tuple(x) for x in stale.collect()] == [("p", "forks", "t050")]
    kept, fresh, gone = (got["p", "forks", t] for t in ("t000", "t050", "gone"))
    assert (kept.human_verified, kept.reviewers, kept.ground_truth_version, kept.note) == (True, ["me"], 3, "kept") and (fresh.human_verified, fresh.reviewers, fresh.ground_truth_version, fresh.note, fresh.evidence_hash) == (False, [], 1, "", "ht050")
    assert gone.note == "verified" and ("p", "forks", "gone2") not in got
    budget = 40 - len(true)
    for p, s, n in (("p", "forks", 117), ("p", "style", 2), ("q", "forks", 58)):
        every = 119 if p == "p" else 58
        cap = max(1, round(round(budget * every / 177) * n / every))
        own = sorted(x[2] for x in rows if x[0] == p and x[1] == s and x[3] != "true_finding")
        chosen = set(own) if len(own) <= cap else {own[int(round(j * (len(own) / cap)))] for j in range(cap)}
        assert {t for pp, ss, t in got if (pp, ss) == (p, s) and got[pp, ss, t].label == "false_positive" and t != "gone"} == chosen


def test_levels(spark):
    found = spark.createDataFrame([("a", "1", "high", 10), ("a", "2", "low", 5), ("b", "1", "low", 1), ("b", "9", "low", 1)], "scanner string, target_id string, cohort string, tokens long")
    labels = spark.createDataFrame([("a", "1", True, "x"), ("b", "1", True, "x"), ("a", "2", False, None), ("a", "7", True, "x"), ("b", "8", True, None)], "scanner string, target_id string, is_true boolean, issue string")
    got = {(r.level, r.name): (r.candidates, r.labelled, r.true_findings, r.false_positives, r.unmatched, r.unique_issues, r.tokens, r.precision) for r in scoring.label_levels(found, labels).collect()}
    assert got == {
        ("all", None): (4, 3, 2, 1, 2, 1, 17, 0.667), ("scanner", "a"): (2, 2, 1, 1, 1, 1, 15, 0.5), ("scanner", "b"): (2, 1, 1, 0, 1, 1, 2, 1.0), ("cohort", "high"): (1, 1, 1, 0, 0, 1, 10, 1.0),
        ("cohort", "low"): (3, 2, 1, 1, 0, 1, 7, 0.5), ("issue", "x"): (2, 2, 2, 0, 1, 1, 11, 1.0), ("issue", "b/8"): (0, 0, 0, 0, 1, 0, 0, None),
    }
