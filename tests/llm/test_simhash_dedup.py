import random

from xxhash import xxh64_intdigest

from tracewell.llm import simhash_dedup
from tracewell.llm.simhash_dedup import fingerprint, keep_one, links, near_duplicates
from tracewell.operators import graph

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string, fp string"


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\x09\x0a\x0b\x0c\x0d":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in fps}


def texts():
    r = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    out = [None, "", "one", "Two Words", "\x85nel   stays\x0btab\tend", "ÀÉ İ K É"]
    for _ in range(12):
        base = [r.choice(words) for _ in range(r.choice([3, 40, 200, 400]))]
        out.append(" ".join(base))
        for _ in range(4):
            b = list(base)
            b[r.randrange(len(b))] = r.choice(words)
            out.append(" ".join(b).upper() if r.random() < 0.3 else "\n".join(b))
        out.append(" ".join(base))
    return out


def test_fingerprint():
    for t in texts():
        assert fingerprint(t) == plain_fingerprint(t)


def test_links_against_all_pairs(spark):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(30)]
    fps = set(seeds) | {0}
    for s in seeds[:12]:
        for _ in range(25):
            x = s
            for _ in range(r.randrange(1, 7)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = {x - 2**64 if x >> 63 else x for x in fps}
    want = plain_components(fps)
    got = dict(links(spark.createDataFrame([(x,) for x in fps], "fp long")).collect())
    linked = {x for x in fps if sum(want[y] == want[x] for y in fps) > 1}
    assert set(got) == linked
    assert all(got[x] == want[x] for x in linked)


def test_near_duplicates_and_keep_one(spark):
    rows = [(i if i % 9 else None, t, "en", "s", 1, "x", "y") for i, t in enumerate(texts())]
    rows += [rows[3], rows[3], (rows[8][0], "something else", None, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    fps = [plain_fingerprint(r[1]) for r in rows]
    root = plain_components(set(fps))
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    want = sorted((str(r[0]), f"{f:016x}", str(least.get(root[f]))) for r, f in zip(rows, fps))
    assert sorted((str(a), b, str(c)) for a, b, c in near_duplicates(docs).collect()) == want
    kept = keep_one(docs).collect()
    assert len(kept) == len(set(root.values()))
    assert {root[plain_fingerprint(x.text)] for x in kept} == set(root.values())
    assert all(x.doc_id == least.get(root[plain_fingerprint(x.text)]) for x in kept)


def test_empty(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(docs).count() == 0
    assert keep_one(docs).columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert keep_one(docs).count() == 0


def test_a_small_graph_takes_few_jobs(spark):
    from tracewell.llm import simhash_dedup

    # Each driver job leaves plans and code behind, and rounds of components were most of them.
    sc, fps = spark.sparkContext, spark.range(3000).selectExpr("xxhash64(id div 3) ^ shiftleft(1L, CAST(id % 3 AS INT)) AS fp")
    sc.setJobGroup("few", "links of 3,000 fingerprints")
    try:
        roots = simhash_dedup.links(fps).groupBy("root").count().collect()
        jobs = len(sc.statusTracker().getJobIdsForGroup("few"))
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(roots) == 1000 and {r["count"] for r in roots} == {3} and jobs <= 40
    print(jobs, "jobs")


def test_nothing_is_broadcast_by_the_size_of_its_files(spark, monkeypatch):
    """Replicas are 30 rows to each fingerprint, which Spark's estimate leaves out."""
    plans, seen = [], simhash_dedup.stash

    def told(df, label, keep=False):
        plans.append((label, df._jdf.queryExecution().executedPlan().toString()))
        return seen(df, label, keep)

    monkeypatch.setattr(simhash_dedup, "stash", told)
    monkeypatch.setattr(graph, "stash", told)
    df = spark.createDataFrame([(i, f"{' '.join(f'w{i % 40}x{j}' for j in range(40))} {'end' if i % 3 else 'other'}") for i in range(80)], "doc_id long, text string")
    out = near_duplicates(df)
    plans.append(("labelled", out._jdf.queryExecution().executedPlan().toString()))
    assert len({r["component_id"] for r in out.collect()}) < 80
    assert {"met", "many", "mixed", "rooted", "labels"} <= {p[0] for p in plans} and [p[0] for p in plans if "BroadcastHashJoin" in p[1]] == []
    big = graph.components(spark.range(100).selectExpr("id AS a", "id + 1 AS b"))
    assert big.count() == 101 and [p[0] for p in plans if "BroadcastHashJoin" in p[1]] == []
