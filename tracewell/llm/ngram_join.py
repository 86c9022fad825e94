"""Set-similarity join of documents by the Jaccard similarity of their word n-grams: rare-first prefixes with length, positional and suffix filters.

A document's set: its distinct N-grams of words (the whole sequence, if it has fewer words), as hashes of 64 bits. Two sets link if LIKE[1] * intersection >=
LIKE[0] * union, in integers. Equal sets, told by digests of 128 bits, are one before any pair is made.

All n-grams have one order, and a set's prefix are its first n - ceil(0.9 * n) + 1: two sets that link share an n-gram of both prefixes. Any order is right; the rarest first
leave least to compare. They are ordered twice, so that not all have to be counted. First only the n-grams whose hash is among the lowest 1 / COUNTED of all are, and come first, by the number
of sets that have them; the others follow by hash. Most sets share nothing of such a prefix with a set of like length, and drop out. For those that are left, whole sets are read
again, and all n-grams are ordered by the number of these sets that have them.

- Length and position: sets of n and m n-grams whose first common one stands at places i and j (from 0) have at most min(n - i, m - j) in common. That depends on (n, i) and (m, j)
  alone, so the sets at an n-gram are put into classes by (n, i), and classes meet before their members do; the number of classes follows the lengths of texts, not how many there are.
- Suffix: a set's n-grams are counted in RANGES equal ranges of the order by hash; two sets have no more in common than the sum of the smaller counts.
- Verification: what is left is intersected as whole sets, each pair once.

For components not every pair is needed. At an n-gram each class compares its smallest member with its others and with those of the classes that it meets; the components of
these links are formed; members of different components are compared within lots of LOT, and components formed again; and only members of different components of classes that meet still are. So a
group of near copies costs rows in proportion to its size, and no link between two components is lost. `pairs` gives every pair of different sets that link.

Nulls, empties, ties: a text that is null or has no word has the empty set, n_shingles 0, and links with nothing; its component is its own doc_id. Rows with equal doc_id, or with
none, each keep a row; component_id is the smallest doc_id that is not null in the component (null if there is none). Columns other than doc_id and text play no part, whatever their
names. An empty table gives an empty result. Two different n-grams of one pair of sets share a hash with a probability of about n * m / 2**64.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import FEW
from ..plans.tables import broadcast_if_small, discard
from .common import batches_of, components, scratch, stash

N = 3
#: Intersection to union.
LIKE = (90, 100)
#: One n-gram of so many is counted.
COUNTED = 4
#: Ranges of the order by hash for the suffix filter.
RANGES = 64
#: Members of a class that are compared with each other before the components of their links are formed.
LOT = 64
#: Keys of rows, 8 bytes each, that are sent to every task at most.
BROADCAST_ROWS = 2_000_000
SEED = 42
#: Rows of a batch: each may hold a long text.
BATCH = 1000


def _mixed(x):
    import numpy as np

    for shift, times in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(times)
    return x ^ (x >> np.uint64(32))


def ngrams(text: str | None):
    """The hashes of a text's distinct n-grams as signed numbers in ascending order. Words lose the case of A-Z only and are parted by ASCII's white space."""
    import numpy as np
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    each = np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))
    long = min(N, len(each))
    if not long:
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        h = np.full(len(each) - long + 1, SEED + long, np.uint64)
        for i in range(long):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + each[i : len(each) - long + 1 + i])
    return np.unique(h.view(np.int64))


def prefix_length(n: int) -> int:
    return n - -(-LIKE[0] * n // LIKE[1]) + 1


def _digest(grams) -> list[int]:
    from xxhash import xxh3_128_intdigest

    d = xxh3_128_intdigest(grams.tobytes(), SEED)
    return [x - (1 << 64) if x >> 63 else x for x in (d >> 64, d & (1 << 64) - 1)]


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row its digest (hi, lo), n, the first n-grams by hash, as many as are counted or as the prefix may need, and the counts in RANGES."""
    import numpy as np

    edge = -(1 << 63) + (1 << 64) // COUNTED
    cuts = np.array([-(1 << 63) + (1 << 64) // RANGES * i for i in range(1, RANGES)], np.int64)
    for b in batches:
        digests, sizes, counted, firsts, ranges = [], [], [], [], []
        for t in b.column(1):
            g = ngrams(t.as_py())
            low = int(np.searchsorted(g, edge))
            digests.append(_digest(g))
            sizes.append(len(g))
            counted.append(low)
            firsts.append(g[: max(low, prefix_length(len(g)))])
            ranges.append(np.diff(np.searchsorted(g, cuts), prepend=0, append=len(g)).astype(np.int32))
        hi, lo = zip(*digests, strict=True) if digests else ((), ())
        columns = [b.column(0), b.column(2), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sizes, pa.int64()), pa.array(counted, pa.int64()), pa.array(firsts, pa.list_(pa.int64())), pa.array(ranges, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "rid", "hi", "lo", "n", "n_counted", "firsts", "ranges"])


SKETCH = "doc_id bigint, rid bigint, hi bigint, lo bigint, n bigint, n_counted bigint, firsts array<bigint>, ranges array<int>"


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sets = [ngrams(t.as_py()) for t in b.column(0)]
        hi, lo = zip(*map(_digest, sets), strict=True) if sets else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["hi", "lo", "grams"])


def _least(n: str, m: str) -> str:
    """SQL of how much sets of n and m have to have in common: the smallest i with LIKE[1] * i >= LIKE[0] * (n + m - i)."""
    return f"(({LIKE[0]}L * ({n} + {m}) + {sum(LIKE) - 1}L) div {sum(LIKE)}L)"


def _may(a: str, b: str) -> str:
    """SQL of the length and the positional filter for classes (n, at)."""
    length = f"{LIKE[1]} * least({a}.n, {b}.n) >= {LIKE[0]} * greatest({a}.n, {b}.n)"
    return f"{length} AND least({a}.n - {a}.at, {b}.n - {b}.at) >= {_least(f'{a}.n', f'{b}.n')}"


def rows_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text, rid); rid is a hash of doc_id and text, by which a row with a set is found again."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("rid", F.xxhash64("doc_id", "text"))


def prefixes(sets: DataFrame) -> DataFrame:
    """(key, id, n, at): the n-grams of each set's prefix with their places, but for those counted that no other set has. sets: (id, n, n_counted, firsts)."""
    sets = sets.withColumn("long", F.expr(f"n - ({LIKE[0]}L * n + {LIKE[1] - 1}L) div {LIKE[1]}L + 1"))
    counted = sets.select("id", F.explode(F.expr("slice(firsts, 1, CAST(n_counted AS INT))")).alias("key"))
    often = stash(counted.groupBy("key").agg(F.count("*").alias("df")).where("df > 1"), "often")
    met = counted.join(often, "key").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("met"))
    own = met.join(sets.select("id", "n", "n_counted", "long"), "id").withColumn("alone", F.expr("n_counted - size(met)"))
    first = own.where("long > alone").select("id", "n", "alone", F.posexplode(F.expr("slice(met, 1, CAST(long - alone AS INT))")).alias("i", "x"))
    first = first.select(F.col("x.key").alias("key"), "id", "n", (F.col("alone") + F.col("i")).alias("at"))
    rest = sets.where("long > n_counted").select("id", "n", "n_counted", F.posexplode(F.expr("slice(firsts, CAST(n_counted AS INT) + 1, CAST(long - n_counted AS INT))")).alias("i", "key"))
    return stash(first.unionByName(rest.select("key", "id", "n", (F.col("n_counted") + F.col("i")).alias("at"))), "prefixes")


def _classes(prefix: DataFrame, *more: str) -> DataFrame:
    """(key, n, at, *more, first, many): classes at keys that more than one set has."""
    classes = prefix.groupBy("key", "n", "at", *more).agg(F.min("id").alias("first"), F.count("*").alias("many"))
    shared = classes.groupBy("key").agg(F.sum("many").alias("all")).where("all > 1").select("key")
    return stash(classes.join(shared, "key", "left_semi"), "classes")


def _meeting(classes: DataFrame, also: str = "true") -> DataFrame:
    """Pairs of classes (a, b) of one key that may hold a link; each unordered pair once, a class with itself too."""
    once = "(a.n, a.at, a.first) <= (b.n, b.at, b.first)"
    return classes.alias("a").join(classes.alias("b"), F.expr(f"a.key = b.key AND {once} AND {_may('a', 'b')} AND {also}"))


def _pair(a: str, b: str) -> tuple[Column, Column]:
    return F.expr(f"least({a}, {b})").alias("a"), F.expr(f"greatest({a}, {b})").alias("b")


def _common(a: str, b: str) -> str:
    """SQL of the most that two sets of these counts in RANGES can have in common."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> least(x, y)), 0L, (s, x) -> s + x)"


def _crowd(prefix: DataFrame, whole: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(key, n, at, id, root, ranges): the prefixes with each set's component and counts, at keys that hold more than one component. roots: (node, root); without, each set is one."""
    sets = whole.select("id", "ranges")
    if roots is not None:
        sets = sets.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "ranges", F.coalesce("root", "id").alias("root"))
    else:
        sets = sets.withColumn("root", F.col("id"))
    owned = stash(prefix.join(sets.select("id", "root"), "id"), "owned")
    mixed = owned.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left = owned.join(mixed, "key", "left_semi")
    return stash(left.join(sets.select("id", "ranges"), "id").select("key", "n", "at", "id", "root", "ranges"), "crowd")


def _side(crowd: DataFrame, s: str, keys: tuple[str, ...]) -> DataFrame:
    return crowd.select(*[c if c == "key" else F.col(c).alias(f"{c}_{s}") for c in ("key", *keys, "id", "ranges")])


def _members(crowd: DataFrame, met: DataFrame) -> DataFrame:
    """Pairs of members of the classes that meet, those that pass the suffix filter. met: (key, n_a, at_a, root_a, n_b, at_b, root_b)."""
    own = ("n", "at", "root")
    out = met.join(_side(crowd, "a", own), ["key", *[f"{c}_a" for c in own]]).alias("l").join(
        _side(crowd, "b", own).alias("r"), F.expr(f"l.key = r.key AND l.n_b = r.n_b AND l.at_b = r.at_b AND l.root_b = r.root_b AND id_a <> id_b AND {_common('ranges_a', 'ranges_b')} >= {_least('n_a', 'l.n_b')}")
    )
    return out.select(*_pair("id_a", "id_b")).distinct()


def _beside(crowd: DataFrame) -> DataFrame:
    """Pairs of members of different components within lots of about LOT of those at a key that have equal sizes: in proportion to their number, and enough to join up most of a group whose
    sets are near the limit to one another."""
    many = crowd.groupBy("key", "n").agg(F.count("*").alias("many")).where("many > 1")
    lots = crowd.join(many, ["key", "n"]).withColumn("lot", F.expr(f"pmod(xxhash64(id), (many + {LOT - 1}) div {LOT})"))
    a, b = (_side(lots, s, ("n", "at", "lot", "root")).alias(x) for s, x in (("a", "l"), ("b", "r")))
    fits = f"n_a - greatest(at_a, at_b) >= {_least('n_a', 'n_b')} AND {_common('ranges_a', 'ranges_b')} >= {_least('n_a', 'n_b')}"
    met = a.join(b, F.expr(f"l.key = r.key AND n_a = n_b AND lot_a = lot_b AND id_a < id_b AND root_a <> root_b AND {fits}"))
    return met.select(*_pair("id_a", "id_b")).distinct()


def _sides(met: DataFrame, *more: str) -> DataFrame:
    return met.select("a.key", *[F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("n", "at", *more)])


def star_pairs(prefix: DataFrame, classes: DataFrame) -> DataFrame:
    """Each class's smallest member with its others, and with the smallest of those it meets."""
    met = _meeting(classes).select(F.col("a.first").alias("x"), F.col("b.first").alias("y")).where("x <> y").select(*_pair("x", "y"))
    within = classes.where("many > 1").alias("a").where(_may("a", "a")).join(prefix.alias("p"), ["key", "n", "at"]).where("id <> first").select(*_pair("id", "first"))
    return met.unionAll(within).distinct()


def whole_sets(ids: DataFrame, sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, n, ranges, grams) of the ids asked for, from their texts. sets: (id, hi, lo, n, rid, ranges), rows: (doc_id, text, rid)."""
    wanted = stash(sets.select("id", "hi", "lo", "rid", "n", "ranges").join(ids, "id", "left_semi"), "wanted")
    texts = rows.join(broadcast_if_small(wanted.select("rid"), BROADCAST_ROWS), "rid", "left_semi").select("text")
    with batches_of(rows.sparkSession, BATCH):
        found = texts.mapInArrow(_sets, "hi bigint, lo bigint, grams array<bigint>").dropDuplicates(["hi", "lo"])
        return stash(found.join(wanted, ["hi", "lo"]).select("id", "n", "ranges", "grams"), "whole")


def verified(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, n_both) of the pairs (a, b) that link: those that pass the suffix filter, intersected."""
    side = lambda s: whole.select(F.col("id").alias(s), F.col("n").alias(f"n_{s}"), F.col("ranges").alias(f"r_{s}"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(f"{_common('r_a', 'r_b')} >= {_least('n_a', 'n_b')}").select("a", "b", "n_a", "n_b")
    side = lambda s: whole.select(F.col("id").alias(s), F.col("grams").alias(f"g_{s}"))
    both = near.join(side("a"), "a").join(side("b"), "b").withColumn("n_both", F.expr("CAST(size(array_intersect(g_a, g_b)) AS BIGINT)"))
    return both.where(f"n_both >= {_least('n_a', 'n_b')}").select("a", "b", "n_a", "n_b", "n_both")


def _distinct(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their sets' digests (doc_id, hi, lo, n), the distinct sets that aren't empty with an id each, and the rows themselves."""
    rows = rows_of(docs)
    with batches_of(docs.sparkSession, BATCH):
        sketches = rows.select("doc_id", "text", "rid").mapInArrow(_sketches, SKETCH)
        sketches = stash(sketches.withColumn("id", F.monotonically_increasing_id()), "sketches")
    marked = stash(sketches.select("doc_id", "hi", "lo", "n"), "marked", keep=True)
    one = sketches.where("n > 0").groupBy("hi", "lo").agg(F.min("id").alias("id")).select("id")
    sets = stash(sketches.drop("doc_id").join(one, "id", "left_semi"), "sets")
    discard(sketches)
    return marked, sets, rows


def _left(sets: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Whole sets that may link to another, and their prefixes. By the n-grams counted first, sets whose classes meet no other class and hold no other set
    fall out. Those that are left are few enough for all their n-grams to be counted, among themselves."""
    prefix = prefixes(sets)
    met = _meeting(_classes(prefix)).where("NOT (a.n = b.n AND a.at = b.at AND a.many = 1)")
    sides = _sides(met).select("key", F.explode(F.expr("array(struct(n_a AS n, at_a AS at), struct(n_b AS n, at_b AS at))")).alias("c")).select("key", "c.n", "c.at").distinct()
    whole = whole_sets(prefix.join(sides, ["key", "n", "at"], "left_semi").select("id").distinct(), sets, rows)
    discard(prefix)
    return whole, prefixes(whole.select("id", "n", F.col("n").alias("n_counted"), F.col("grams").alias("firsts")))


def links(sets: DataFrame, rows: DataFrame) -> DataFrame:
    """(node, root) of the sets that link to another."""
    whole, prefix = _left(sets, rows)
    star = stash(star_pairs(prefix, _classes(prefix)), "star")
    joined = stash(components(verified(star, whole), few=FEW), "joined")
    beside = stash(_beside(_crowd(prefix, whole, joined)).join(star, ["a", "b"], "left_anti"), "beside")
    joined = stash(components(verified(beside, whole).select("a", "b").unionAll(joined.select("node", "root")), few=FEW), "joined")
    crowd = _crowd(prefix, whole, joined)
    met = stash(_sides(_meeting(_classes(crowd, "root"), "a.root <> b.root"), "root"), "met")
    more = stash(_members(crowd, met).join(star.unionAll(beside), ["a", "b"], "left_anti"), "more")
    return components(verified(more, whole).select("a", "b").unionAll(joined.select("node", "root")), few=FEW)


def join_components(docs: DataFrame) -> DataFrame:
    """(doc_id long, n_shingles long, component_id long), a row for each row of docs."""
    with scratch():
        marked, sets, rows = _distinct(docs)
        roots = links(sets, rows).withColumnRenamed("node", "id")
        firsts = marked.where("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("first"))
        rooted = sets.select("id", "hi", "lo").join(roots, "id", "left").select("hi", "lo", F.coalesce("root", "id").alias("root")).join(firsts, ["hi", "lo"])
        rooted = stash(rooted, "rooted")
        least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
        labels = stash(rooted.join(least, "root").select("hi", "lo", "component_id"), "labels", keep=True)
    found = marked.join(labels, ["hi", "lo"], "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def pairs(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every link between different sets as (a, b, n_a, n_b, n_both), and membership: (doc_id, set), set being null for the empty one."""
    with scratch():
        marked, sets, rows = _distinct(docs)
        whole, prefix = _left(sets, rows)
        crowd = _crowd(prefix, whole, None)
        every = stash(_members(crowd, stash(_sides(_meeting(_classes(crowd, "root"), "a.root <> b.root"), "root"), "met")), "candidates")
        found = stash(verified(every, whole), "pairs", keep=True)
        names = stash(sets.select("hi", "lo", F.col("id").alias("set")), "names", keep=True)
    return found, marked.join(names, ["hi", "lo"], "left").select("doc_id", "set")


#: By an inverted list of n-grams and a closure in DuckDB.
SQL = """
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT r, doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM w
), c AS (
  SELECT min(r) AS id, d, len(any_value(s)) AS n FROM (SELECT r, s, md5(array_to_string(list_sort(s), chr(10))) AS d FROM s WHERE len(s) > 0) GROUP BY d
), m AS (
  SELECT s.r, s.doc_id, len(s.s) AS n, c.id FROM s LEFT JOIN c ON c.d = md5(array_to_string(list_sort(s.s), chr(10))) AND len(s.s) > 0
), g AS (
  SELECT c.id, c.n, unnest(s.s) AS g FROM c JOIN s ON s.r = c.id
), p AS (
  SELECT x.id AS a, y.id AS b FROM g x JOIN g y ON x.g = y.g AND x.id < y.id AND 100 * least(x.n, y.n) >= 90 * greatest(x.n, y.n)
  GROUP BY x.id, y.id, x.n, y.n HAVING 100 * count(*) >= 90 * (x.n + y.n - count(*))
), e AS (
  SELECT a, b FROM p UNION SELECT b, a FROM p
), t AS (
  SELECT a AS id, a AS other FROM e UNION SELECT t.id, e.b FROM t JOIN e ON e.a = t.other
), o AS (
  SELECT id, min(doc_id) AS first FROM m WHERE id IS NOT NULL GROUP BY id
), k AS (
  SELECT o.id, least(o.first, min(x.first)) AS component_id FROM o LEFT JOIN t ON t.id = o.id LEFT JOIN o x ON x.id = t.other GROUP BY o.id, o.first
)
SELECT m.doc_id, CAST(m.n AS BIGINT) AS n_shingles, CASE WHEN m.n = 0 THEN m.doc_id ELSE k.component_id END AS component_id FROM m LEFT JOIN k ON k.id = m.id
"""
