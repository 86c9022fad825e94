"""Personal data by fixed patterns, widened by bootstrapped contexts; DataFrame functions only.

The base finds e-mail addresses, IP addresses, payment cards and phone numbers. They are the seeds of a bootstrap. A candidate is a token
of letters, digits and joining marks with DIGITS digits or more. Its patterns are lexical: the CONTEXT words before it, each with the marks and spaces after it.

With wide=True there is more. Candidates are also tokens of LENGTH letters and digits or more with a digit; those that have the shape of a key (SECRET) are seeds too,
but only in a sample of the texts, one of parts by their hash (SEED_PARTS, to measure; the query takes all): elsewhere nothing but learned patterns finds them, and no span comes of SECRET itself. And there are more
patterns: the last word by itself if a mark such as = follows it (label); the label with the candidate's alphabet and length (label|hex:40); the HEAD letters that a candidate
begins with, with its alphabet and length (AKIA|upper:20).

Patterns and candidates form a graph: a pattern is linked to every value that it meets. Each of ROUNDS rounds scores patterns by the share of their
occurrences in the sample whose value is known (a seed's, or found in a round before), keeps every one that reaches CONFIDENCE (wide=True: SURE), was seen there with
SUPPORT values or more and has a known one, and makes every value known that one of them meets in any text. wide=False has all texts in the sample. Values stand as hashes in
the graph. In the end a candidate is a span of kind id if one of its patterns is kept in any round and no base span overlaps it.

Occurrences of candidates and seeds are written once; the graph and the result are both made from them. The kept patterns are a written table, whose number follows the input. The graph is counted by
(pattern, value) before it is dealt out, so a pattern that a third of all rows share is one row for each value and task.
Candidates meet the kept patterns in a join, and what is found goes back by 128 bits of the text; the patterns are broadcast only if their
rows, once counted, are few, what is found only if its characters are. Base spans are made in the documents' rows. Candidates and base spans of a text are held against each other in one pass over their order.

Nulls and the like: a null text is read as empty. Rows may repeat and ids may be null: every row stands by itself. Patterns tie
by their text. A candidate at the very start of a text has no context; it is found by its head alone. Other columns play no part. An empty table
gives an empty result. A token may have any length: the patterns' loops are possessive, which Java runs without recursion, and begin where a run of their
characters begins or the match before ends, so that they read a text once. A text without any digit has no candidates.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.tables import broadcast_if_small
from .common import SPAN, TOGETHER, held, in_parts, match_spans, scratch, stash

#: The kinds and their patterns.
KINDS = {
    "email": "[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "[0-9]++(?:\\.[0-9]++)(?:\\.[0-9]++)(?:\\.[0-9]++)",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: Where a match of a kind can begin, besides where the one before ended.
BEGINS = {"email": "[A-Za-z0-9._%+-]", "ip": "[0-9]"}
#: What a text must hold for its pattern to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
FOUND = "id"
#: Seeds of the sample: identifiers of access keys, and numbers of 16 hexadecimal digits or more that have letters too.
SECRET = "^(?:AKIA[0-9A-Z]{16}|(?=[0-9]*+[a-f])(?=[a-f]*+[0-9])[0-9a-f]{16,}+)$"
#: Texts in how many have seeds of these shapes; the sample that scores are taken from, where others have to be left to measure by.
SEED_PARTS = 2
DIGITS = 3
#: A token, where the run that it begins has as many digits as it takes; so the words of a text are no matches.
CANDIDATE = f"(?<![A-Za-z0-9])(?<![A-Za-z0-9][._/-])(?=(?:[A-Za-z]*+(?:[._/-][A-Za-z]++)*+[._/-]?[0-9]){{{DIGITS}}})[A-Za-z0-9](?:[._/-]?[A-Za-z0-9])*+"
#: With wide: also what begins with LENGTH letters and digits, a digit among its first run of them.
LENGTH, HEAD = 16, 4
WIDE_CANDIDATE = CANDIDATE.replace("{%d})" % DIGITS, "{%d}|(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{%d})" % (DIGITS, LENGTH))
#: What a value is written in, the first that fits.
ALPHABETS = {"hex": "[0-9a-f]", "upper": "[0-9A-Z]", "lower": "[0-9a-z]", "both": "[0-9A-Za-z]"}
CONTEXT = 2
#: What makes one word by itself a context: a mark that labels what follows. Words such as `of` would else be contexts.
LABEL = "[:=#\"']"
ROUNDS, CONFIDENCE, SUPPORT = 3, 0.2, 3
SURE = 0.8
#: Contexts that a round keeps at most: no bound.
PATTERNS = None
#: Patterns that are broadcast at most, and characters of what is found.
BROADCAST_ROWS, BROADCAST_CHARS = 200_000, 32_000_000
_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Of 13 to 19 digits: whether every second one from the right doubled, less 9 if over 9, and the others sum to a multiple of 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(f"^{_PART}(?:\\.{_PART}){{3}}$")
    n = F.length(_digits(value))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(value))).otherwise(False)
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _pattern(kind: str) -> str:
    """The same matches as KINDS[kind] alone would have: a run in which none begins at its first character has none."""
    return f"(?:(?<!{BEGINS[kind]})|\\G){KINDS[kind]}" if kind in BEGINS else KINDS[kind]


def _base(docs: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    """The columns of carry as _c0 and on, _t, and the spans of each kind, null where the pattern has no match."""
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_t"))
    # No pattern matches without a digit, but the first.
    rows = rows.withColumn("_digit", F.col("_t").rlike("[0-9]"))
    for kind in KINDS:
        need = F.contains("_t", F.lit(NEEDS[kind])) if NEEDS[kind] else F.lit(True)
        if kind != "email":
            need = F.col("_digit") & need
        rows = rows.withColumn(kind, F.filter(F.when(need, match_spans(F.col("_t"), F.lit(_pattern(kind)))), partial(lambda k, s: _passes(k, s["value"]), kind)))
    return rows.withColumn("_rid", F.when(F.col("_digit"), F.md5(F.col("_t").cast("binary"))))


def _context(before: Column, words: int = CONTEXT) -> Column:
    """The words at the end of what stands before a place, lower-cased; empty if there are too few."""
    return F.regexp_extract(F.lower(before), f"((?:\\p{{L}}+[^\\p{{L}}\\p{{N}}]{{1,4}}){{{words}}})$", 1)


def _met_by(span: Column, wide: bool) -> Column:
    """All patterns that meet a span, the most specific first."""
    before, value = span["before"], span["value"]
    each = [_context(before, CONTEXT)]
    if wide:
        word = _context(before, 1)
        label = F.when(word.rlike(LABEL), word)
        alphabet = F.coalesce(*[F.when(value.rlike(f"^{a}++$"), F.lit(n)) for n, a in ALPHABETS.items()])
        shape = F.when(F.length(value) >= LENGTH, F.concat(F.lit("|"), alphabet, F.lit(":"), F.length(value).cast("string")))
        head = F.regexp_extract(value, f"^[A-Za-z]{{{HEAD}}}", 0)
        each += [F.concat(label, shape), label, F.when(head != "", F.concat(head, shape))]
    return F.filter(F.array_distinct(F.array(*each)), lambda c: c != "")


def _free(candidates: Column, base: Column) -> Column:
    """The candidates, which don't overlap each other, that no base span overlaps: one pass over the starts of both. One waits until what comes next is known."""
    place = lambda s, i: F.struct(s["start"].alias("start"), s["end"].alias("end"), i.alias("i"))
    every = F.array_sort(F.concat(F.transform(base, lambda b: place(b, F.lit(-1))), F.transform(candidates, place)))
    none = F.array().cast("array<int>")

    def step(s: Column, x: Column) -> Column:
        is_base, waits = x["i"] < 0, F.when(s["i"] >= 0, F.concat(s["out"], F.array(s["i"]))).otherwise(s["out"])
        return F.struct(
            F.when(is_base, F.greatest(s["reach"], x["end"])).otherwise(s["reach"]).alias("reach"),
            F.when(is_base, F.when(x["start"] < s["end"], -1).otherwise(s["i"])).otherwise(F.when(x["start"] >= s["reach"], x["i"]).otherwise(-1)).alias("i"),
            F.when(is_base, s["end"]).otherwise(x["end"]).alias("end"),
            F.when(is_base, s["out"]).otherwise(waits).alias("out"),
        )

    def lot(s: Column, some: Column) -> Column:
        """Few at a time, so that no long array is copied for each."""
        start = F.struct(s["reach"].alias("reach"), s["i"].alias("i"), s["end"].alias("end"), none.alias("out"))
        return F.aggregate(some, start, step, lambda r: F.struct(r["reach"].alias("reach"), r["i"].alias("i"), r["end"].alias("end"), F.concat(s["lots"], F.array(r["out"])).alias("lots")))

    start = F.struct(F.lit(0).alias("reach"), F.lit(-1).alias("i"), F.lit(0).alias("end"), F.array().cast("array<array<int>>").alias("lots"))
    last = lambda s: F.flatten(F.concat(s["lots"], F.array(F.when(s["i"] >= 0, F.array(s["i"])).otherwise(none))))
    kept = held(every, lambda v: F.aggregate(in_parts(v, TOGETHER), start, lot, last))
    return F.transform(kept, lambda i: F.get(candidates, i))


def occurrences(docs: DataFrame, wide: bool = False, parts: int = SEED_PARTS) -> DataFrame:
    """(rid, start, end, value, hash, seed, sampled, patterns): a row for each seed and each candidate that a pattern meets, in texts with a digit or an @. Seeds
    of the base have no value, only its hash. Equal texts have their rows once each."""
    rows = _base(docs.where("text RLIKE '[0-9@]'"), ())
    empty = F.array().cast(f"array<{SPAN}>")
    base = F.concat(*[F.coalesce(k, empty) for k in KINDS])
    spans = F.when(F.col("_digit"), match_spans(F.col("_t"), F.lit(WIDE_CANDIDATE if wide else CANDIDATE)))
    if not wide:
        spans = F.filter(spans, lambda s: F.length(_digits(s["value"])) >= DIGITS)
    rows = rows.withColumn("_b", base).withColumn("_s", F.coalesce(spans, empty)).withColumn("_s", F.when((F.size("_b") > 0) & (F.size("_s") > 0), _free(F.col("_s"), F.col("_b"))).otherwise(F.col("_s")))
    rows = rows.withColumn("sampled", F.pmod(F.xxhash64("_t"), F.lit(parts)) == 0 if wide else F.lit(True))
    secret = lambda s: F.col("sampled") & s["value"].rlike(SECRET) if wide else F.lit(False)

    def row(s: Column, own: bool) -> Column:
        value = F.lit(None).cast("string") if own else s["value"]
        return F.struct(s["start"].alias("start"), s["end"].alias("end"), value.alias("value"), F.xxhash64(F.lower(s["value"])).alias("hash"), (F.lit(True) if own else secret(s)).alias("seed"), _met_by(s, wide).alias("patterns"))

    both = F.concat(F.transform("_b", lambda s: row(s, True)), F.transform("_s", lambda s: row(s, False)))
    return rows.select("_rid", "sampled", F.explode(both).alias("x")).select(F.col("_rid").alias("rid"), "x.start", "x.end", "x.value", "x.hash", "x.seed", "sampled", "x.patterns").where("size(patterns) > 0")


def graph(met: DataFrame) -> DataFrame:
    """(context, value, n, seed) of occurrences: how often a pattern meets a value (a hash) in the sample, and whether it is a seed."""
    each = met.select(F.col("hash").alias("value"), "seed", "sampled", F.explode("patterns").alias("context"))
    return each.groupBy("context", "value").agg(F.count_if("sampled").alias("n"), F.max("seed").alias("seed"))


def _bootstrap(met: DataFrame, wide: bool) -> DataFrame:
    links, least = stash(graph(met), "graph"), SURE if wide else CONFIDENCE
    known, kept = links.where("seed").select("value").distinct(), None
    for i in range(ROUNDS):
        scored = links.where("n > 0").join(known.withColumn("known", F.lit(1)), "value", "left").groupBy("context").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.coalesce("known", F.lit(0))).alias("hits"), F.count("*").alias("support"))
        good = scored.where(f"hits > 0 AND support >= {SUPPORT} AND hits >= n * {least}D")
        if kept is not None:
            good = good.join(broadcast_if_small(kept.select("context"), BROADCAST_ROWS), "context", "left_anti")
        new = stash(good.select("context", F.lit(i).alias("round"), F.expr("hits / n * log2(1 + hits)").alias("score")), "kept", keep=True)
        kept = new if kept is None else kept.unionAll(new)
        if new.isEmpty():
            break
        found = links.join(broadcast_if_small(new.select("context"), BROADCAST_ROWS), "context", "left_semi").select("value")
        known = stash(known.unionAll(found).distinct(), "known")
    return kept


def contexts(docs: DataFrame, wide: bool = False) -> DataFrame:
    """(context, round, score) of the patterns that the rounds keep."""
    with scratch():
        return _bootstrap(occurrences(docs, wide), wide)


def patterns(docs: DataFrame, wide: bool = False) -> list[str]:
    """The contexts that the rounds keep, in the order of their finding, at the driver; for small inputs."""
    return [r.context for r in contexts(docs, wide).orderBy("round", F.desc("score"), "context").collect()]


def find(docs: DataFrame, kept: DataFrame | None = None, carry: tuple[str, ...] = ("doc_id",), wide: bool = False, parts: int = SEED_PARTS) -> DataFrame:
    """The columns of carry; n_email, n_ip, n_card, n_phone (base spans, long), base_sha256, spans (all of them as kind:start:end), and
    found: array of (start, end, value, context) of the spans that a pattern found, with the first of its patterns that is kept. kept: contexts, else those of docs. parts: one text in so many
    teaches by SECRET; 1 for every text, where none has to be left over to measure by."""
    with scratch():
        met = stash(occurrences(docs, wide, parts), "occurrences")
        if kept is None:
            kept = _bootstrap(met, wide)
        spare = met.where("value IS NOT NULL").select("rid", "start", "end", "value", F.posexplode("patterns").alias("at", "context"))
        hits = spare.join(broadcast_if_small(kept.select("context"), BROADCAST_ROWS), "context", "left_semi")
        # Equal texts have the same spans.
        one = hits.groupBy("rid", "start", "end").agg(F.min_by("context", "at").alias("context"), F.first("value").alias("value"))
        found = F.array_sort(F.collect_list(F.struct("start", "end", "value", "context"))).alias("found")
        chars = (F.sum(F.length("value") + F.length("context")) + 100 * F.count("*")).alias("chars")
        hits = stash(one.groupBy(F.col("rid").alias("_rid")).agg(found, chars), "found", keep=True)
    small = (hits.agg(F.sum("chars")).first()[0] or 0) <= BROADCAST_CHARS
    hits = hits.drop("chars")
    rows = _base(docs, carry).join(F.broadcast(hits) if small else hits, "_rid", "left")

    def said(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))

    none = F.array().cast("array<string>")
    base = F.concat(*[F.coalesce(said(k, F.col(k)), none) for k in KINDS])
    return rows.select(
        *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)],
        *[F.greatest(F.size(k), F.lit(0)).cast("bigint").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, F.coalesce(said(FOUND, F.col("found")), none)), ",").alias("spans"),
        "found",
    )
