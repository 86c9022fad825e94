import hashlib
import math
import random
import re
import time
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tracewell.llm import pii

SCHEMA = "doc_id long, text string, found string, email string, _t string"


def luhn(d):
    each = [int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))]
    return sum(each) % 10 == 0


def plain_base(text):
    digits = lambda v: re.sub("[^0-9]", "", v)
    good = {
        "email": lambda v: True,
        "ip": lambda v: all(int(x) <= 255 for x in v.split(".")),
        "card": lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v)),
        "phone": lambda v: 9 <= len(digits(v)) <= 15,
    }
    return {k: [(m.start(), m.end(), m[0]) for m in re.finditer(p.replace("\\x20", " "), text or "") if good[k](m[0])] for k, p in pii.KINDS.items()}


def plain_context(text, start):
    words = re.findall(r"[^\W\d_]+[^\w]{1,4}", text[max(0, start - 80) : start].lower())
    tail = "".join(words[-2:])
    return tail if len(words) >= 2 and text[:start].lower().endswith(tail) else ""


def plain_find(texts):
    base = [plain_base(t) for t in texts]
    spare, met, seeds = [], Counter(), set()
    for t, b in zip(texts, base):
        t = t or ""
        taken = [s for spans in b.values() for s in spans]
        own = [(m.start(), m.end(), m[0]) for m in re.finditer("[A-Za-z0-9](?:[._/-]?[A-Za-z0-9])*", t) if len(re.sub("[^0-9]", "", m[0])) >= 3 and not any(s < m.end() and m.start() < e for s, e, _ in taken)]
        own = [(*x, plain_context(t, x[0])) for x in own]
        spare.append([x for x in own if x[3]])
        for s, _, v in taken:
            seeds |= {v.lower()} if plain_context(t, s) else set()
            met[plain_context(t, s), v.lower()] += 1
        for x in spare[-1]:
            met[x[3], x[2].lower()] += 1
    known, kept = set(seeds), []
    for _ in range(pii.ROUNDS):
        by = defaultdict(list)
        for (c, v), n in met.items():
            if c and c not in kept:
                by[c].append((n, n * (v in known)))
        scored = [(-sum(h for _, h in x) / sum(n for n, _ in x) * math.log2(1 + sum(h for _, h in x)), c) for c, x in by.items() if len(x) >= pii.SUPPORT and 0 < sum(h for _, h in x) >= pii.CONFIDENCE * sum(n for n, _ in x)]
        new = [c for _, c in sorted(scored)[: pii.PATTERNS]]
        if not new:
            break
        kept += new
        known |= {v for c, v in met if c in new}
    return base, kept, [[x for x in own if x[3] in kept] for own in spare]


def texts():
    r = random.Random(4)
    digits = lambda n: "".join(r.choices("0123456789", k=n))
    out = [None, "", "no data", "+1 (555) 010-9999", "a@b.c.", "1.2.3.4.5.6", "300.1.1.1", "00255.1.1.01 é 1.1.1.1", "4111 1111-1111 1111", "4111111111111112", "x+4 12345678 9", "über@müller.de foo@x-y.co.uk,bar%a@q.org"]
    for i in range(60):
        kind = r.choice(["mail me at a%s@ex.org now", "my account id 4111 1111 1111 1111 ok", "the account id K-%s is", "the account id %s is", "his badge no %s and", "call us on +44 20 7946 0%s", "order has nothing %s", "äö über %s"])
        out.append("Çé " * r.randrange(3) + (kind % digits(r.randrange(3, 9)) if "%" in kind else kind))
    for _ in range(30):
        out.append("".join(r.choices("0123456789.-+() @aZ/_\n", k=40)))
    return [*out, "pad é " * 20_000 + "q@r.st"]


def test_against_plain(spark):
    every = texts()
    docs = spark.createDataFrame([(i if i % 5 else None, t, "x", "y", str(i)) for i, t in enumerate(every)], SCHEMA).repartition(3)
    base, kept, found = plain_find(every)
    assert kept and any(found)
    assert pii.patterns(docs) == kept
    got = pii.find(docs.withColumnRenamed("_t", "i"), carry=("doc_id", "i")).collect()
    assert len(got) == len(every)
    for x in got:
        i = int(x.i)
        said = [f"{k}:{s}:{e}" for k, spans in base[i].items() for s, e, _ in spans]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [len(s) for s in base[i].values()]
        assert x.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert x.spans == ",".join([*said, *(f"id:{s}:{e}" for s, e, _, _ in found[i])])


def test_many_spans_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd " * 3000, None, None, None)], SCHEMA)
    assert pii.find(docs).first().n_email == 3000
    assert pii.find(docs.where("false")).count() == 0


def test_more_contexts_than_fifty(spark):
    """Every context that qualifies is kept, and what stands after it is found: 70 contexts of an e-mail, a phone and an identifier each."""
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in ("ap", "eq", "ir", "os", "ut", "yv", "az")]
    rows = [(3 * i + k, f"so then {w} no {v}", None, None, None) for i, w in enumerate(words) for k, v in enumerate((f"a{i}@b.cd", f"+44 20 7946 {1000 + i}", f"K-{1000 + i}"))]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(pii.patterns(docs)) == sorted(f"{w} no " for w in words)
    got = {x.doc_id: [s.value for s in x.found or []] for x in pii.find(docs).collect()}
    assert got == {r[0]: [f"K-{1000 + r[0] // 3}"] if r[0] % 3 == 2 else [] for r in rows}


def test_long_tokens(spark):
    """A million characters in one token, of every kind and of candidates: neither a stack that overflows nor a text read again and again."""
    n = 10**6
    tokens = {
        "digits": "7" * n, "spaced": "7 " * (n // 2), "letters": "a" * n, "joined": "a.b-" * (n // 4), "apart": "a..b--" * (n // 6), "mail": "a" * n + "@" + "b" * n + ".cd" * n,
        "half": "x" * n + " @", "dotted": "1." * (n // 2), "phone": "+1" + " " * n + "2", "hex": "0a" * (n // 2), "base64": "aB3/" * (n // 4),
    }
    docs = spark.createDataFrame([(i, f"our account {t}", None, None, None) for i, t in enumerate(tokens.values())], SCHEMA)
    got = {x.doc_id: x for x in pii.find(docs, wide=True).collect()}
    of = {k: got[i] for i, k in enumerate(tokens)}
    assert len(got) == len(tokens) and of["mail"].n_email == 1 and of["mail"].spans == f"email:12:{12 + 2 * n + 1 + 3 * n}"
    assert of["dotted"].n_ip == n // 8 and of["hex"].spans == "" and sum(x.n_card + x.n_phone for x in got.values()) == 0


def test_base_where_matches_touch(spark):
    """Runs that go on after a match, by the patterns of the contract as they stand."""
    contract = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([ -]?[0-9])+", "phone": r"\+[0-9][ ().0-9-]+[0-9]"}
    r = random.Random(8)
    every = ["a@b.c_d@e.f", "a@b.cd@e.f@g.h", "x..a@b.c%q@r.s", "1.2.3.4.5.6.7.8.9", "12.1.1.1.1a1.1.1.1", *("".join(r.choices("ab1.@_%-+ 7", k=50)) for _ in range(300))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(every)], SCHEMA)
    rows = pii._base(docs, ("doc_id",)).select("_c0", *[f"{k}.value" for k in ()], *contract).collect()
    assert len(rows) == len(every)
    for x in rows:
        for kind, pattern in contract.items():
            want = [(m.start(), m.end(), m[0]) for m in re.finditer(pattern, every[x["_c0"]])]
            digits = lambda v: re.sub("[^0-9]", "", v)
            good = {"email": lambda v: True, "ip": lambda v: all(int(y) <= 255 for y in v.split(".")), "card": lambda v: 13 <= len(digits(v)) <= 19 and luhn(digits(v)), "phone": lambda v: 9 <= len(digits(v)) <= 15}[kind]
            assert [(s.start, s.end, s.value) for s in x[kind] or []] == [w for w in want if good(w[2])]


def test_many_candidates_among_many_base_spans(spark):
    """20,000 card numbers, a candidate after each, in one text: one pass over both."""
    r = random.Random(6)
    card = "4111 1111 1111 1111"
    text = "".join(f"{card}, id = K-{i:05} {'+44 20 7946 0999' if i % 3 else ''}; " for i in range(20_000))
    docs = spark.createDataFrame([(1, text, None, None, None)], SCHEMA)
    start = time.monotonic()
    row = pii.find(docs, spark.createDataFrame([("id = ",)], "context string"), wide=True).first()
    assert (row.n_card, row.n_phone, len(row.found)) == (20_000, text.count("+44"), 20_000)
    assert [f.value for f in row.found] == [f"K-{i:05}" for i in range(20_000)]
    assert time.monotonic() - start < 60


def test_free_against_plain(spark):
    r = random.Random(9)

    def spans(n):
        cuts = sorted(r.sample(range(300), 2 * n))
        return [(a, b, "", "") for a, b in zip(cuts[::2], cuts[1::2])]

    rows = [(spans(r.randrange(70)), [x for _ in range(3) for x in spans(r.randrange(8))]) for _ in range(200)]
    kind = f"array<{pii.SPAN}>"
    got = spark.createDataFrame(rows, f"c {kind}, b {kind}").select("c", "b", pii._free(F.col("c"), F.col("b")).alias("free")).collect()
    for x in got:
        assert x.free == [c for c in x.c if not any(b.start < c.end and c.start < b.end for b in x.b)]


def test_wide_finds_what_follows_the_patterns_of_secrets(spark):
    """Keys of known shapes in half of the texts are seeds; what stands where they stand or begins as they do is found in all, what stands elsewhere isn't."""
    r = random.Random(5)
    word = lambda: "".join(r.choices("bcdfghklmn", k=6))
    rows = [(i, f'{word()} {word()} token = "{"".join(a + b for a, b in zip(r.choices("0123456789", k=20), r.choices("abcdef", k=20)))}" {word()}', None, None, None) for i in range(20)]
    rows += [(100 + i, f'{word()} {word()} token = "Tk{r.randrange(10**6):06}-{word()}" {word()}', None, None, None) for i in range(2)]
    rows += [(200 + i, f"{word()} {word()} page {r.randrange(1000, 9999)} of {word()}", None, None, None) for i in range(30)]
    rows += [(300 + i, f"{word()} {word()} AKIA{''.join(r.choices('QRSTUVWXYZ', k=15))}7 end", None, None, None) for i in range(20)]
    rows += [(400, f"{word()} {word()} BKIA{'Q' * 15}7 end", None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {'token = "', "AKIA|upper:20", 'token = "|hex:40'} >= set(pii.patterns(docs, wide=True)) >= {"AKIA|upper:20", 'token = "|hex:40'}
    got = {x.doc_id: x.spans for x in pii.find(docs, wide=True).collect()}
    assert all(got[i].startswith("id:") for i in (*range(20), *range(300, 320))) and not any(got[i] for i in (*range(200, 230), 400))


def test_secrets_of_the_documents(spark):
    """Of the keys in texts outside the sample, which no seed stands in, 0.9 or more are found, and nine of ten spans found are keys."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    key = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|(?=[0-9]*[a-fA-F])(?:[0-9a-f]{16,}|[0-9A-F]{16,}))(?![A-Za-z0-9])")
    sampled = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(pii.SEED_PARTS)) == 0
    texts = {(x.doc_id, x.text or "") for x in docs.where(~sampled).select("doc_id", "text").collect()}
    planted = {(d, m.start()) for d, t in texts for m in key.finditer(t)}
    found = {(x.doc_id, f.start) for x in pii.find(docs, wide=True).collect() for f in x.found or [] if x.doc_id in {d for d, _ in texts}}
    assert planted and len(planted & found) >= 0.9 * len(planted) and len(planted & found) >= 0.9 * len(found)


def test_query_learns_from_every_text(spark, tmp_path):
    """Keys of a pattern that stands only in texts outside the sample: the query counts these too."""
    from tracewell.llm.queries import op8_pii

    rows = [(i, f"line {i} begins\nvault_pin = {hashlib.md5(str(i).encode()).hexdigest()} and goes on") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.where(F.pmod(F.xxhash64("text"), F.lit(pii.SEED_PARTS)) != 0).write.parquet(f"{tmp_path}/documents.parquet")
    got = op8_pii(spark, str(tmp_path)).collect()
    assert len(got) > 10 and all(r["spans"].startswith("id:") for r in got)
