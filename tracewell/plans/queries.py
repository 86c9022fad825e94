"""Queries over the driver's tables, one or more for each operator, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import variants
from ..functions.ids import short_hash
from ..operators import findings, lines, references, retrieval, review, sampling, scoring, similarity, spans, style
from ..operators.graph import FEW, components
from ..scanners import deadcode
from ..sources import records, trees
from .tables import broadcast_if_small, spread, stash, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- copies and near copies ---------------------------------------------------


@query("""
SELECT substr(sha256(first_key), 1, 12) AS cluster_id, size, file_count, first_key FROM (
  SELECT count(*) AS size, count(DISTINCT source) AS file_count, min(source || ':' || doc_id) AS first_key
  FROM documents GROUP BY sha256(lower(text)) HAVING count(*) > 1)
""")
def dup_exact_clusters(spark: SparkSession, d: str) -> DataFrame:
    return similarity.exact_clusters(spread(table(spark, d, "documents")), F.lower("text"), F.concat_ws(":", "source", "doc_id"), "source")


def _records(spark: SparkSession, d: str) -> DataFrame:
    """A representative of each distinct token sequence of 20 tokens or more: key, tokens, lang, source, n_lines."""
    docs = spread(table(spark, d, "documents")).withColumn("tokens", T.plain_tokens("text")).where("size(tokens) >= 20")
    first = docs.groupBy(F.sha2(F.array_join("tokens", " "), 256).alias("h")).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return docs.join(stash(first, "first"), "doc_id", "left_semi").select(F.col("doc_id").alias("key"), "tokens", "lang", "source", (F.regexp_count("text", F.lit("\n")) + 1).alias("n_lines"))


_RECORDS = """
tok AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens, len(string_split(text, chr(10))) AS n_lines FROM documents),
rec AS (SELECT doc_id AS key, lang, source, tokens, n_lines FROM (
  SELECT *, row_number() OVER (PARTITION BY tokens ORDER BY doc_id) AS copy FROM tok WHERE len(tokens) >= 20) WHERE copy = 1),
el AS (SELECT key, list(token || '#' || k) AS bag FROM (
  SELECT key, token, row_number() OVER (PARTITION BY key, token) AS k FROM (SELECT key, unnest(tokens) AS token FROM rec)) GROUP BY key),
full_rec AS (SELECT rec.*, el.bag, len(tokens) AS n FROM rec JOIN el USING (key))
"""
_QUICK = _RECORDS + """,
pairs AS (SELECT * FROM (
  SELECT l.key AS a, r.key AS b, 2.0 * len(list_intersect(l.bag, r.bag)) / (l.n + r.n) AS similarity
  FROM full_rec l JOIN full_rec r ON l.key < r.key AND l.lang = r.lang AND least(l.n, r.n) >= greatest(l.n, r.n) * 0.9) WHERE similarity >= 0.9)
"""


def _quick(spark: SparkSession, d: str) -> DataFrame:
    return similarity.quick_pairs(_records(spark, d), 0.9, same="lang")


@query(f"WITH {_QUICK} SELECT a, b, round(similarity, 6) AS similarity FROM pairs")
def dup_quick_pairs(spark: SparkSession, d: str) -> DataFrame:
    return _quick(spark, d).withColumn("similarity", F.round("similarity", 6))


_COMPONENTS = """,
e AS (SELECT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs),
walk AS (SELECT u AS node, u AS seen FROM e UNION SELECT walk.node, e.v FROM walk JOIN e ON walk.seen = e.u),
comp AS (SELECT node, min(seen) AS root FROM walk GROUP BY node)
"""


@query(f"WITH RECURSIVE {_QUICK} {_COMPONENTS} SELECT node, root FROM comp")
def dup_components(spark: SparkSession, d: str) -> DataFrame:
    return components(_quick(spark, d).select("a", "b"), few=FEW)


@query(f"""WITH RECURSIVE {_QUICK} {_COMPONENTS},
m AS (SELECT comp.root, rec.source, rec.n_lines FROM comp JOIN rec ON comp.node = rec.key),
own AS (SELECT root, count(*) AS size, count(DISTINCT source) AS file_count, max(n_lines) AS max_lines,
  bool_or(source = 'src0') AND bool_or(source <> 'src0') AS lib_shared FROM m GROUP BY root),
best AS (SELECT comp.root, round(max(similarity), 6) AS max_sim FROM pairs JOIN comp ON pairs.a = comp.node GROUP BY comp.root)
SELECT root, size, file_count, max_lines, max_sim, CASE WHEN (lib_shared AND max_lines > 7) OR (file_count > 1 AND ((max_lines > 19 AND max_sim >= 0.95) OR (size > 4 AND max_lines > 9))) THEN 'high'
  WHEN file_count > 1 AND max_lines > 7 THEN 'medium' ELSE 'low' END AS priority FROM own JOIN best USING (root)
""")
def dup_priority_ladder(spark: SparkSession, d: str) -> DataFrame:
    records = stash(_records(spark, d), "all")
    pairs = similarity.quick_pairs(records, 0.9, same="lang", written=True)
    roots = stash(components(pairs.select("a", "b"), few=FEW), "roots")
    members = roots.join(records.select(F.col("key").alias("node"), F.col("source").alias("grp"), "n_lines", (F.col("source") == "src0").alias("lib")), "node")
    edges = pairs.join(roots, pairs["a"] == roots["node"]).select("root", "similarity")
    return similarity.cluster_ladder(members, edges)


def _copies(spark: SparkSession, d: str) -> DataFrame:
    """Every document of 20 tokens or more: key, lang, source, n_lines, class (the smallest key of its token sequence), rep (of those in its lang)."""
    docs = spread(table(spark, d, "documents")).withColumn("tokens", T.plain_tokens("text")).where("size(tokens) >= 20")
    copies = stash(docs.select(F.col("doc_id").alias("key"), "lang", "source", (F.regexp_count("text", F.lit("\n")) + 1).alias("n_lines"), F.sha2(F.array_join("tokens", " "), 256).alias("h")), "copies")
    reps = stash(copies.groupBy("h", "lang").agg(F.min("key").alias("rep")), "reps")
    classes = stash(reps.groupBy("h").agg(F.min("rep").alias("class")), "classes")
    same = reps.join(classes, "h").withColumnRenamed("lang", "_lang")
    return stash(copies.join(same, (copies["h"] == same["h"]) & copies["lang"].eqNullSafe(same["_lang"])).select("key", "lang", "source", "n_lines", "class", "rep"), "members")


def _ratio_pairs(spark: SparkSession, d: str, copies: DataFrame) -> DataFrame:
    """(a, b, ratio) of the representatives in each lang whose matching-block ratio is 0.82 or more; the smaller key goes first."""
    docs = spread(table(spark, d, "documents")).select(F.col("doc_id").alias("key"), "lang", T.plain_tokens("text").alias("tokens"))
    records = stash(docs.join(copies.where("key = rep").select("key"), "key", "left_semi"), "all")
    # The quick ratio is an upper bound of the ratio.
    return similarity.ratio_pairs(similarity.quick_pairs(records, 0.82, same="lang", written=True).select("a", "b"), records, 0.82)


def _clustered(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(root, key, class, source, n_lines) of every member of a cluster of two or more, and (root, similarity) of its edges."""
    copies = _copies(spark, d)
    pairs = stash(_ratio_pairs(spark, d, copies), "pairs")
    # Equal sequences are one node whatever their lang, so a large group of copies is no star of edges.
    of = copies.where("key = rep").select("rep", "class")
    ends = pairs.join(of.select(F.col("rep").alias("a"), F.col("class").alias("u")), "a").join(of.select(F.col("rep").alias("b"), F.col("class").alias("v")), "b")
    roots = stash(components(ends.where("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b"))), "roots").withColumnRenamed("node", "class")
    rooted = stash(copies.join(roots, "class", "left").select(F.coalesce("root", "class").alias("root"), "key", "class", "source", "n_lines"), "rooted")
    members = rooted.join(rooted.groupBy("root").agg(F.count("*").alias("size")).where("size > 1").select("root"), "root", "left_semi")
    equal = rooted.where("key <> class").select("root", F.lit(1.0).alias("similarity")).distinct()
    edges = ends.join(roots, ends["u"] == roots["class"]).select("root", F.col("ratio").alias("similarity")).unionAll(equal)
    return members, edges


@query()
def dup_members(spark: SparkSession, d: str) -> DataFrame:
    """Every document of a cluster, copies included: root (the smallest key of all), key, class (the smallest key of its token sequence).
    Equal sequences link in any lang and source, others of one lang by a matching-block ratio of 0.82, which SQL can't state."""
    return _clustered(spark, d)[0].select("root", "key", "class")


@query()
def dup_member_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The ladder over every member of the clusters of dup_members."""
    members, edges = _clustered(spark, d)
    return similarity.cluster_ladder(members.select("root", F.col("source").alias("grp"), "n_lines", (F.col("source") == "src0").alias("lib")), edges)


@query(f"""WITH {_RECORDS}
SELECT l.key AS a, r.key AS b, round(2.0 * len(list_intersect(l.bag, r.bag)) / (l.n + r.n), 6) AS similarity
FROM full_rec l JOIN full_rec r ON l.key < r.key AND least(l.n, r.n) >= greatest(l.n, r.n) * 0.9
  AND l.source <> r.source AND l.n_lines BETWEEN 8 AND 39 AND r.n_lines BETWEEN 8 AND 39 AND abs(l.n_lines // 5 - r.n_lines // 5) <= 4
WHERE 2.0 * len(list_intersect(l.bag, r.bag)) / (l.n + r.n) >= 0.9
""")
def fork_small_pairs(spark: SparkSession, d: str) -> DataFrame:
    records = _records(spark, d).where("n_lines BETWEEN 8 AND 39").withColumn("band", F.expr("n_lines div 5"))
    return similarity.quick_pairs(records, 0.9, residual="l.source <> r.source AND abs(l.band - r.band) <= 4").withColumn("similarity", F.round("similarity", 6))


@query(f"""WITH {_QUICK}, d AS (SELECT a, b, list_distinct(l.tokens) AS x, list_distinct(r.tokens) AS y FROM pairs JOIN rec l ON l.key = a JOIN rec r ON r.key = b)
SELECT a, b, list_aggregate(list_sort(list_filter(x, lambda t: NOT list_contains(y, t)))[1:12], 'string_agg', ',') AS left_only,
  list_aggregate(list_sort(list_filter(y, lambda t: NOT list_contains(x, t)))[1:12], 'string_agg', ',') AS right_only FROM d
""")
def pair_identifier_diff(spark: SparkSession, d: str) -> DataFrame:
    records = stash(_records(spark, d), "all")
    return similarity.own_tokens(similarity.quick_pairs(records, 0.9, same="lang", written=True).select("a", "b"), records)


@query()
def seq_ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Matching-block similarity of 0.82 or more, which SQL can't state, of distinct token sequences of one lang; the smaller key goes first."""
    return _ratio_pairs(spark, d, _copies(spark, d))


@query("""
WITH t AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS tokens FROM benchmark), n AS (SELECT item_id, len(tokens) AS n, len(tokens) // 8 AS b FROM t),
c AS (SELECT item_id, token, count(*) AS c FROM (SELECT item_id, unnest(tokens) AS token FROM t) GROUP BY ALL),
s AS (SELECT l.item_id AS a, r.item_id AS b, sum(least(l.c, r.c)) AS shared FROM c l JOIN c r ON l.token = r.token AND l.item_id < r.item_id GROUP BY ALL)
SELECT s.a, s.b, CAST(shared AS BIGINT) AS shared FROM s JOIN n l ON l.item_id = s.a JOIN n r ON r.item_id = s.b
WHERE least(l.n, r.n) >= greatest(l.n, r.n) * 0.5 AND shared >= 0.25 * greatest(l.n, r.n)
  AND (abs(l.b - r.b) <= 1 OR abs(l.b - r.b) = 2 AND (l.b + r.b) // 2 IN (SELECT b FROM n))
""")
def twin_multiset_prefilter(spark: SparkSession, d: str) -> DataFrame:
    """Bands of eight tokens; two bands apart only meet if the one between has a record."""
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("key"), T.plain_tokens("text").alias("tokens")).withColumn("n", F.size("tokens")).withColumn("band", F.expr("n div 8"))
    counts = items.select("key", "n", "band", F.explode("tokens").alias("token")).groupBy("key", "n", "band", "token").agg(F.count("*").alias("c"))
    bands = items.select(F.col("band").alias("middle")).distinct()
    l, r = counts.alias("l"), counts.alias("r")
    met = l.join(r, F.expr("l.token = r.token AND l.key < r.key AND abs(l.band - r.band) <= 2 AND least(l.n, r.n) >= greatest(l.n, r.n) * 0.5D"))
    met = met.groupBy(F.col("l.key").alias("a"), F.col("r.key").alias("b"), F.expr("greatest(l.n, r.n)").alias("most"), F.expr("IF(abs(l.band - r.band) = 2, (l.band + r.band) div 2, NULL)").alias("middle"))
    shared = met.agg(F.sum(F.expr("least(l.c, r.c)")).alias("shared")).where("shared >= 0.25D * most")
    return shared.where("middle IS NULL").unionByName(shared.join(bands, "middle", "left_semi").select(shared.columns)).select("a", "b", "shared")


_GRAMS = "IF(size(tokens) >= 5, transform(sequence(1, greatest(size(tokens) - 4, 1)), i -> array_join(slice(tokens, i, 5), ' ')), CAST(array() AS array<string>))"


@query("""
WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
bg AS (SELECT DISTINCT item_id, gram FROM (SELECT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM b WHERE len(w) >= 5)),
dg AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS gram FROM d WHERE len(w) >= 5)),
n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY item_id)
SELECT item_id AS helper, doc_id AS text, count(*) AS n_shared, round(count(*) * 1.0 / n, 6) AS coverage FROM bg JOIN dg USING (gram) JOIN n USING (item_id)
GROUP BY item_id, doc_id, n HAVING count(*) >= 0.6 * n
""")
def helper_coverage(spark: SparkSession, d: str) -> DataFrame:
    # Written first: else the tokenizer would be inlined into the function of every position.
    grams = lambda df, key: stash(df.select(key, T.plain_tokens("text").alias("tokens")), key).where("size(tokens) >= 5").select(key, F.expr(_GRAMS).alias("grams"))
    return references.covered_by(grams(table(spark, d, "benchmark"), "item_id"), grams(spread(table(spark, d, "documents")), "doc_id"), "item_id", "doc_id", "grams", 0.6)


# -- spans -----------------------------------------------------------------------


@query("""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 21600000000 THEN 1 ELSE 0 END AS cut FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(cut) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, min(event_id) AS first_event, max(event_id) AS last_event FROM i GROUP BY user_id, island
""")
def event_islands(spark: SparkSession, d: str) -> DataFrame:
    """Runs of a user's events with no gap of more than six hours."""
    cut = spans.islands(table(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], F.expr("unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(CAST(prev AS TIMESTAMP)) > 21600000000"))
    return cut.groupBy("user_id", "island").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


@query("""
WITH s AS (SELECT o_custkey, o_orderkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) + o_orderkey % 400 AS e FROM orders),
r AS (SELECT *, max(e) OVER (PARTITION BY o_custkey ORDER BY s, e DESC, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
SELECT o_custkey, o_orderkey, CAST(s AS BIGINT) AS first_day, CAST(e AS BIGINT) AS last_day FROM r WHERE reach IS NULL OR reach < e
""")
def contained_spans(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint").alias("first_day"))
    own = own.withColumn("last_day", F.col("first_day") + F.col("o_orderkey") % 400)
    return spans.drop_contained(own, "o_custkey", "first_day", "last_day", "o_orderkey")


# -- references --------------------------------------------------------------------


@query("""
SELECT 'part' AS kind, p_partkey AS key FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 AND l_partkey IS NOT NULL)
UNION ALL SELECT 'customer', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)
""")
def unreferenced_keys(spark: SparkSession, d: str) -> DataFrame:
    part = references.unreferenced(table(spark, d, "part").select("p_partkey"), table(spark, d, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45"), "p_partkey", "l_partkey")
    customer = references.unreferenced(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders"), "c_custkey", "o_custkey")
    return part.select(F.lit("part").alias("kind"), F.col("p_partkey").alias("key")).unionByName(customer.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key")))


@query("""
WITH h AS (SELECT page_id, list_reverse(string_split(regexp_extract(url, '^https?://([^/?#]+)', 1), '.')) AS p FROM pages),
a AS (SELECT page_id, unnest(list_transform(range(1, len(p) + 1), lambda i: array_to_string(p[1:i], '.'))) AS host FROM h), m AS (SELECT DISTINCT array_to_string(p, '.') AS host FROM h)
SELECT host, count(*) AS n_pages FROM a JOIN m USING (host) GROUP BY host
""")
def prefix_reference_join(spark: SparkSession, d: str) -> DataFrame:
    """Hosts read from the right as dotted names: every host counts its own pages and those of hosts under it."""
    host = F.array_join(F.reverse(F.split(F.regexp_extract("url", "^https?://([^/?#]+)", 1), "[.]")), ".")
    pages = table(spark, d, "pages").select("page_id", host.alias("name"))
    return references.prefix_references(pages, pages.select(F.col("name").alias("host")).distinct(), "name", "host").groupBy("host").agg(F.count("*").alias("n_pages"))


_LADDER = """CASE WHEN coalesce(trim(text), '') = '' THEN 'PARSE-ERROR' WHEN source = 'src1' THEN 'TEST' WHEN n_chars < 100 THEN 'PACKAGE'
  WHEN quality = 1 THEN 'USED' WHEN toxic = 1 THEN 'ENTRYPOINT' WHEN quality = 0 THEN 'DOC-ONLY' WHEN lang <> 'en' THEN 'PUBLIC_API_CANDIDATE' ELSE 'DEAD' END"""


@query(f"SELECT status, count(*) AS n FROM (SELECT {_LADDER} AS status FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY status")
def status_ladder(spark: SparkSession, d: str) -> DataFrame:
    """The scanner's own ladder; properties of documents stand for those of modules."""
    flags = {"failed": "coalesce(trim(text), '') = ''", "is_test": "source = 'src1'", "is_package": "n_chars < 100", "referred": "quality = 1", "mentioned": "false", "has_main": "toxic = 1", "documented": "quality = 0", "public": "lang <> 'en'"}
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(*[F.expr(f"coalesce({e}, false)").alias(n) for n, e in flags.items()])
    return docs.select(F.expr(deadcode.LADDER).alias("status")).groupBy("status").agg(F.count("*").alias("n"))


@query("SELECT p_name AS name, count(DISTINCT p_brand) AS n_groups, count(*) AS n FROM part GROUP BY p_name HAVING count(DISTINCT p_brand) >= 20")
def same_name_groups(spark: SparkSession, d: str) -> DataFrame:
    return references.same_name_groups(table(spark, d, "part"), "p_name", "p_brand", 20)


@query("""
SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events e
  WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.value > 90)) WHERE r = 1
""")
def written_not_read(spark: SparkSession, d: str) -> DataFrame:
    """The first signup of each user without a large purchase."""
    events = table(spark, d, "events")
    lone = events.where("event_type = 'signup'").join(events.where("event_type = 'purchase' AND value > 90").select("user_id").distinct(), "user_id", "left_anti")
    return references.first_of_each(lone, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id")


@query("""
WITH l AS (SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 20 = 0), x AS (SELECT * FROM part WHERE p_partkey % 20 <> 0 AND p_type = 'ECONOMY'),
named AS (SELECT l.p_partkey AS part, x.p_partkey AS found, 'name' AS how, 1.0 AS score, abs(l.p_size - x.p_size) AS far FROM l JOIN x ON l.p_name = x.p_name),
rest AS (SELECT * FROM l WHERE p_partkey NOT IN (SELECT part FROM named)),
sets AS (SELECT p_partkey, p_size, list_distinct(string_split(p_name, ' ')) AS t FROM rest), xs AS (SELECT p_partkey, p_size, list_distinct(string_split(p_name, ' ')) AS t FROM x),
near AS (SELECT s.p_partkey AS part, xs.p_partkey AS found, 'words' AS how, len(list_intersect(s.t, xs.t)) * 1.0 / len(list_distinct(list_concat(s.t, xs.t))) AS score, abs(s.p_size - xs.p_size) AS far FROM sets s JOIN xs ON len(list_intersect(s.t, xs.t)) > 0)
SELECT part, found, how, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY part ORDER BY score DESC, far, found) AS r FROM (SELECT * FROM named UNION ALL SELECT * FROM near)) WHERE r = 1
""")
def capability_name_then_doc(spark: SparkSession, d: str) -> DataFrame:
    """By name, and by the words of the name only where no name is the same; then the nearest size. Of a part of the ids and one type, as the SQL has it."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_type")
    return _name_then_words(part.where("p_partkey % 20 = 0"), part.where("p_partkey % 20 <> 0 AND p_type = 'ECONOMY'"))


@query()
def capability_search(spark: SparkSession, d: str) -> DataFrame:
    """The search of capability_name_then_doc for the parts whose key is divisible by 100, among all other parts."""
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    return _name_then_words(part.where("p_partkey % 100 = 0"), part)


def _name_then_words(mine: DataFrame, index: DataFrame) -> DataFrame:
    """(part, found, how, score): the best of index for each of mine, never itself.

    Of all that have a name and a size in common only the smallest key can be best, or the second, where the smallest is the part itself: so rows come from names and sizes, not from parts."""
    mine = mine.select(F.col("p_partkey").alias("part"), "p_name", F.col("p_size").alias("size"))
    index = index.select(F.col("p_partkey").alias("found"), F.col("p_name").alias("name"), F.col("p_size").alias("other"))
    first = stash(index.groupBy("name", "other").agg(F.min("found").alias("first")), "first")
    others = index.alias("i").join(first.alias("f"), F.expr("i.name = f.name AND i.other <=> f.other AND i.found <> f.first"))
    second = others.groupBy(F.col("i.name").alias("name"), F.col("i.other").alias("other")).agg(F.min("i.found").alias("second"))
    kept = stash(first.alias("f").join(second.alias("s"), F.expr("f.name = s.name AND f.other <=> s.other"), "left").select("f.name", "f.other", "first", "second"), "kept")
    named = mine.join(kept, F.expr("p_name = name")).select("part", F.expr("IF(first = part, second, first)").alias("found"), F.lit("name").alias("how"), F.lit(1.0).alias("score"), F.expr("abs(size - other)").alias("far")).where("found IS NOT NULL")
    rest = stash(mine.join(named.select("part").distinct(), "part", "left_anti"), "rest")
    worded = lambda df, c: df.select(c).distinct().withColumn("t", F.array_distinct(F.split(c, " "))).withColumn("w", F.explode("t"))
    l, r = worded(rest, "p_name").alias("l"), worded(first, "name").alias("r")
    # No other part has the name of one of the rest.
    near = stash(l.join(r, F.expr("l.w = r.w AND p_name <> name")).groupBy("p_name", "name").agg(F.first(T.jaccard(F.col("l.t"), F.col("r.t"))).alias("score")), "near")
    best = near.join(near.groupBy("p_name").agg(F.max("score").alias("most")), "p_name").where("score = most")
    sizes = best.join(first, "name").groupBy("p_name", "score", "other").agg(F.min("first").alias("found"))
    every = named.unionByName(rest.join(sizes, "p_name").select("part", "found", F.lit("words").alias("how"), "score", F.expr("abs(size - other)").alias("far")))
    return references.first_of_each(every.withColumn("_s", -F.col("score")), ["part"], ["_s", "far", "found"]).select("part", "found", "how", F.round("score", 6).alias("score"))


@query("""
WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS name FROM benchmark), w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS name FROM documents)
SELECT n.name, count(w.name) AS n FROM n LEFT JOIN w ON n.name = w.name GROUP BY n.name
""")
def usage_counts(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "benchmark").select(F.explode(T.plain_tokens("text")).alias("name"))
    return references.usage_counts(spread(table(spark, d, "documents")), T.plain_tokens("text"), names)


#: Patterns that Java and RE2 read alike.
HARDCODED = {"email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", "access_key": "AKIA[A-Z0-9]{16}", "address": "[0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}[.][0-9]{1,3}"}


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line_text, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents) SELECT *, "
    "substr(sha256(pattern || chr(10) || key || chr(10) || line || chr(10) || hit), 1, 12) AS id FROM ("
    + " UNION ALL ".join(f"SELECT doc_id AS key, '{n}' AS pattern, CAST(line AS INTEGER) AS line, unnest(regexp_extract_all(line_text, '{p}')) AS hit FROM l" for n, p in HARDCODED.items())
    + ")"
)
def hardcoded_regex_hits(spark: SparkSession, d: str) -> DataFrame:
    hits = style.pattern_hits(spread(table(spark, d, "documents")), "doc_id", "text", HARDCODED)
    return hits.withColumn("id", short_hash("pattern", F.col("key").cast("string"), F.col("line").cast("string"), "hit"))


# -- prose ---------------------------------------------------------------------------

_SENTENCES = """
s0 AS (SELECT doc_id AS key, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+([A-Z"''(])', '\\1' || chr(30) || '\\2', 'g'), chr(30)), lambda x: trim(x) <> '') AS s FROM documents),
sent AS (SELECT key, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS i FROM s0),
w AS (SELECT *, len(regexp_extract_all(sentence, '[A-Za-z][A-Za-z''\\-]*[A-Za-z]|[A-Za-z]')) AS n_words FROM sent)
"""


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return style.sentence_table(spread(table(spark, d, "documents")), "doc_id", "text")


@query(f"""WITH {_SENTENCES}
SELECT key, count(*) AS n_sentences, round(avg(n_words), 4) AS mean_words, round(stddev_pop(n_words), 4) AS sd_words,
  round(CASE WHEN avg(n_words) = 0 THEN 0 ELSE stddev_pop(n_words) / avg(n_words) END, 4) AS burstiness,
  CASE WHEN avg(n_words) = 0 THEN 0 ELSE stddev_pop(n_words) / avg(n_words) END < 0.4 AS flagged FROM w GROUP BY key""")
def style_sentence_stats(spark: SparkSession, d: str) -> DataFrame:
    return style.sentence_stats(_sentences(spark, d))


@query(f"WITH {_SENTENCES} SELECT count(*) AS n_sentences, CAST(sum(n_words) AS BIGINT) AS n_words, round(stddev_pop(n_words) / avg(n_words), 6) AS burstiness FROM w")
def style_overall_burstiness(spark: SparkSession, d: str) -> DataFrame:
    return style.overall_burstiness(_sentences(spark, d))


@query(f"""WITH {_SENTENCES}, c AS (SELECT key, i, list_filter(list_transform(string_split(replace(sentence, ',', ';'), ';'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM sent),
z AS (SELECT key, i, parts, list_transform(parts, lambda p: CAST(len(regexp_extract_all(p, '[A-Za-z][A-Za-z''\\-]*[A-Za-z]|[A-Za-z]')) AS DOUBLE)) AS n FROM c WHERE len(parts) >= 3),
y AS (SELECT *, coalesce(list_avg(n) > 0 AND list_stddev_pop(n) / nullif(list_avg(n), 0) < 0.45, false) AS triad_like, len(list_filter(parts, lambda p: regexp_matches(p, '[0-9]|\\[MATH\\]'))) >= 0.5 * len(parts) AS technical FROM z)
SELECT key, CAST(i AS INTEGER) AS i, CAST(len(parts) AS INTEGER) AS subclauses, triad_like, technical, CASE WHEN triad_like AND NOT technical THEN 'high' ELSE 'medium' END AS severity FROM y""")
def style_semicolon_chains(spark: SparkSession, d: str) -> DataFrame:
    """The documents have no semicolons: their commas stand in."""
    return style.semicolon_chains(_sentences(spark, d).withColumn("sentence", F.replace("sentence", F.lit(","), F.lit(";"))))


_OPENERS = ("The", "Of", "Die", "Le", *style.TEMPLATE_OPENERS)


@query(f"WITH {_SENTENCES} SELECT key, CAST(i AS INTEGER) AS i, regexp_extract(sentence, '^({'|'.join(_OPENERS)})[,\\s]', 1) AS opener FROM sent WHERE regexp_matches(sentence, '^({'|'.join(_OPENERS)})[,\\s]')")
def style_openers(spark: SparkSession, d: str) -> DataFrame:
    return style.opener_hits(_sentences(spark, d), _OPENERS)


@query("""WITH d AS (SELECT doc_id, replace(text, 'The that', 'Note that') AS text FROM documents),
s0 AS (SELECT doc_id AS key, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+([A-Z"''(])', '\\1' || chr(30) || '\\2', 'g'), chr(30)), lambda x: trim(x) <> '') AS s FROM d),
sent AS (SELECT key, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS i FROM s0) SELECT key, CAST(i AS INTEGER) AS i FROM sent WHERE regexp_matches(sentence, '(?i)^note that($|[^A-Za-z0-9_])')""")
def style_note_that(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(table(spark, d, "documents")).withColumn("text", F.replace("text", F.lit("The that"), F.lit("Note that")))
    return style.note_that(style.sentence_table(docs, "doc_id", "text"))


@query(
    " UNION ALL ".join(f"SELECT doc_id AS key, '{w}' AS word, CAST(len(regexp_extract_all(text, '(?i)\\b{w}\\b')) AS INTEGER) AS n FROM documents WHERE regexp_matches(text, '(?i)\\b{w}\\b')" for w in ("this", "from", "moreover", "delve"))
)
def style_excess_vocab(spark: SparkSession, d: str) -> DataFrame:
    return style.excess_vocabulary(spread(table(spark, d, "documents")), "doc_id", "text", ("this", "from", "moreover", "delve"))


@query("""
WITH r AS (SELECT doc_id AS key, len(text) - len(replace(text, '!', '')) AS n_dashes, len(regexp_extract_all(text, '[A-Za-z][A-Za-z''\\-]*[A-Za-z]|[A-Za-z]')) AS n_words FROM documents)
SELECT key, CAST(n_dashes AS INTEGER) AS n_dashes, CAST(n_words AS INTEGER) AS n_words, round(n_dashes * 100.0 / n_words, 4) AS per_100 FROM r WHERE n_words > 0 AND n_dashes * 100.0 / n_words >= 0.5""")
def style_em_dash_rate(spark: SparkSession, d: str) -> DataFrame:
    """The documents have no dashes: their exclamation marks stand in."""
    docs = spread(table(spark, d, "documents")).withColumn("text", F.replace("text", F.lit("!"), F.lit("—")))
    return style.em_dash_rate(docs, "doc_id", "text")


# -- retrieval ---------------------------------------------------------------------------

_SETS = """
q AS (SELECT DISTINCT item_id AS query, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM benchmark),
x AS (SELECT DISTINCT doc_id AS key, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents),
f AS (SELECT token, count(*) AS df, ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1.0)) + 1.0 AS idf FROM x GROUP BY token)
"""
_RANK = "SELECT query, CAST(rank AS INTEGER) AS rank, key, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM scored WHERE score > 0) WHERE rank <= 10"


def _sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    docs = spread(table(spark, d, "documents"))
    held = stash(docs.select("doc_id", F.array_distinct(T.plain_tokens("text")).alias("tokens")), "tokens")
    index = held.select(F.col("doc_id").alias("key"), F.explode("tokens").alias("token"))
    queries = stash(retrieval.token_sets(table(spark, d, "benchmark"), "item_id", T.plain_tokens("text")), "queries")
    return broadcast_if_small(queries, 200_000), index, stash(retrieval.idf(index, docs.count()), "idf")


@query(f"WITH {_SETS} SELECT token, df, round(idf, 6) AS idf FROM f WHERE df >= 2")
def idf_table(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return retrieval.idf(retrieval.token_sets(docs, "doc_id", T.plain_tokens("text")), docs.count()).where("df >= 2").withColumn("idf", F.round("idf", 6))


_JACCARD = f"""{_SETS}, wq AS (SELECT query, sum(coalesce(idf, 1.0)) AS wq FROM q LEFT JOIN f USING (token) GROUP BY query), wx AS (SELECT key, sum(idf) AS wx FROM x JOIN f USING (token) GROUP BY key),
met AS (SELECT query, key, sum(idf) AS w FROM q JOIN x USING (token) JOIN f USING (token) GROUP BY query, key),
scored AS (SELECT query, key, round(w / (wq + wx - w), 6) AS score FROM met JOIN wq USING (query) JOIN wx USING (key))"""


@query(f"WITH {_JACCARD} {_RANK}")
def retrieve_weighted_jaccard_topk(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.weighted_jaccard(*_sets(spark, d))


_COVERAGE = f"""{_SETS}, wq AS (SELECT query, sum(coalesce(idf, 1.0)) AS wq FROM q LEFT JOIN f USING (token) GROUP BY query),
scored AS (SELECT query, key, round(sum(idf) / wq, 6) AS score FROM q JOIN x USING (token) JOIN f USING (token) JOIN wq USING (query) GROUP BY query, key, wq)"""


@query(f"WITH {_COVERAGE} {_RANK}")
def retrieve_description_coverage(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.coverage(*_sets(spark, d))


@query(f"""WITH {_SETS}, wq AS (SELECT query, sum(coalesce(idf, 1.0)) AS wq, count(*) AS nq FROM q LEFT JOIN f USING (token) GROUP BY query), nx AS (SELECT key, count(*) AS nx FROM x GROUP BY key),
met AS (SELECT query, key, sum(idf) AS w, count(*) AS n FROM q JOIN x USING (token) JOIN f USING (token) GROUP BY query, key),
each AS (SELECT query, key, round(w / wq, 6) AS string, round(n / (nq + nx - n), 6) AS lexical FROM met JOIN wq USING (query) JOIN nx USING (key)),
scored AS (SELECT *, round(greatest(string * 0.6, lexical * 0.8), 6) AS score FROM each)
SELECT query, CAST(rank AS INTEGER) AS rank, key, score, string, lexical FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM scored WHERE score > 0) WHERE rank <= 10""")
def retrieve_two_channels(spark: SparkSession, d: str) -> DataFrame:
    """The stronger of two channels: the share of an item's weight that a document has, and the even Jaccard similarity."""
    queries, index, weights = _sets(spark, d)
    words, even = retrieval.vocabulary(weights, queries), retrieval.vocabulary(weights.withColumn("idf", F.lit(1.0)), queries)
    string = (retrieval.asked(queries, words), retrieval.records(index, words, "shared"), retrieval.COVERAGE, 0.6)
    lexical = (retrieval.asked(queries, even), retrieval.records(index, even, "even"), retrieval.JACCARD, 0.8)
    return retrieval.strongest({"string": string, "lexical": lexical}, 10)


@query(f"""WITH {_JACCARD}, ranked AS ({_RANK}), calls AS (SELECT a.item_id AS query, b.item_id AS callee, row_number() OVER (PARTITION BY a.item_id ORDER BY b.item_id) AS n FROM benchmark a JOIN benchmark b ON a.item_id <> b.item_id AND a.item_id % 7 = b.item_id % 7),
every AS (SELECT query, key, score FROM ranked UNION ALL SELECT c.query, r.key, r.score FROM calls c JOIN ranked r ON r.query = c.callee WHERE n <= 5), best AS (SELECT query, key, max(score) AS score FROM every GROUP BY query, key)
SELECT query, CAST(rank AS INTEGER) AS rank, key, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM best) WHERE rank <= 10""")
def retrieve_closure(spark: SparkSession, d: str) -> DataFrame:
    """Items call those whose number leaves the same by 7."""
    ranked = stash(retrieval.weighted_jaccard(*_sets(spark, d)), "ranked")
    items = table(spark, d, "benchmark").select("item_id", (F.col("item_id") % 7).alias("m"))
    # The closure takes five callees by name, so six of each group are enough.
    first = items.withColumn("n", F.row_number().over(W.partitionBy("m").orderBy("item_id"))).where("n <= 6").select("m", F.col("item_id").alias("callee"))
    calls = items.withColumnRenamed("item_id", "query").join(first, "m").select("query", "callee")
    return retrieval.closure(ranked, calls)


@query(f"""WITH {_COVERAGE}, ranked AS ({_RANK}), truth AS (SELECT item_id AS query, min(doc_id) AS key FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY item_id)
SELECT count(*) AS n, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_10,
  round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr FROM truth LEFT JOIN ranked USING (query, key)""")
def recall_at_k_mrr(spark: SparkSession, d: str) -> DataFrame:
    """Against the first document that holds an item's text. Only documents with an item's rarest token are searched for it."""
    queries, index, weights = _sets(spark, d)
    ranked = stash(retrieval.coverage(queries, index, weights), "ranked")
    # One row for each item and document, so nothing has to be counted together.
    rarest = weights.join(queries, "token").groupBy(F.col("key").alias("query")).agg(F.min_by("token", F.struct("df", "token")).alias("token"))
    whole = index.join(broadcast_if_small(stash(rarest, "rarest"), 200_000), "token").select("query", "key")
    both = stash(whole, "whole").join(table(spark, d, "benchmark").select(F.col("item_id").alias("query"), F.col("text").alias("said")), "query")
    # The texts stay where they are: what is to be found in them is sent to them, if it is little.
    both = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text").join(broadcast_if_small(stash(both, "sought"), 20_000), "key")
    truth = both.where(F.contains("text", F.col("said"))).groupBy("query").agg(F.min("key").alias("key"))
    return retrieval.recall_and_mrr(ranked, truth)


# -- findings -------------------------------------------------------------------------------

_CLUSTERS = "SELECT o_orderpriority AS scanner, CAST(o_orderkey AS VARCHAR) AS target_id, list_sort(list_distinct(list(CAST(l_partkey % 12 AS VARCHAR)))) AS members FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority"
_FUSED = f"""c AS (SELECT *, array_to_string(members, chr(10)) AS k FROM ({_CLUSTERS})),
p AS (SELECT k, count(DISTINCT scanner) AS n_channels, count(*) AS signals, any_value(len(members)) AS n_members FROM c WHERE len(members) >= 2 GROUP BY k HAVING count(DISTINCT scanner) >= 2),
issues AS (SELECT 'proposed/' || substr(sha256(k), 1, 12) AS issue_id, CAST(n_members AS INTEGER) AS n_members, n_channels, signals FROM p
UNION ALL SELECT scanner || '/' || target_id, CAST(len(members) AS INTEGER), CAST(1 AS BIGINT), CAST(1 AS BIGINT) FROM c WHERE k NOT IN (SELECT k FROM p))"""


def _issues(spark: SparkSession, d: str) -> DataFrame:
    """Orders are clusters, their priority the scanner; the symbols are their parts' last numbers."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 12).cast("string").alias("symbol"))
    symbols = lines.groupBy("o_orderkey").agg(F.collect_set("symbol").alias("symbols"))
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("scanner"), F.col("o_orderkey").cast("string").alias("target_id"))
    return findings.fuse(orders.join(symbols, "o_orderkey").select("scanner", "target_id", "symbols")).select("issue_id", "n_members", "n_channels", "signals")


@query(f"WITH {_FUSED} SELECT * FROM issues")
def fuse_exact_sets(spark: SparkSession, d: str) -> DataFrame:
    return _issues(spark, d)


@query(f"WITH {_FUSED} SELECT count(*) AS issues, count(*) FILTER (WHERE n_channels >= 2) AS corroborated, CAST(sum(signals) AS BIGINT) AS signals, round(count(*) * 1.0 / sum(signals), 3) AS compression FROM issues")
def issue_summary(spark: SparkSession, d: str) -> DataFrame:
    return findings.issue_summary(_issues(spark, d))


_SLICES = "b AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01'), a AS (SELECT DISTINCT o_custkey, o_orderpriority FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01')"


@query(f"WITH {_SLICES} SELECT *, 'new' AS change FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'gone' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)")
def diff_new_gone(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    return findings.difference(orders.where(early), orders.where(~early), ["o_custkey", "o_orderpriority"])


@query(f"""WITH {_SLICES}, g AS (SELECT o_custkey, o_orderpriority, x IS NOT NULL AS old, y IS NOT NULL AS cur FROM (SELECT *, 1 AS x FROM b) FULL JOIN (SELECT *, 1 AS y FROM a) USING (o_custkey, o_orderpriority)),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, old ORDER BY o_custkey) AS k FROM g WHERE old <> cur)
SELECT o_orderpriority AS scanner, count(*) FILTER (WHERE old) AS previous, count(*) FILTER (WHERE cur) AS current, count(*) FILTER (WHERE NOT old) AS new, count(*) FILTER (WHERE NOT cur) AS gone,
  coalesce((SELECT string_agg('c' || o_custkey, ',' ORDER BY k) FROM r WHERE r.o_orderpriority = g.o_orderpriority AND cur AND k <= 15), '') AS first_new,
  coalesce((SELECT string_agg('c' || o_custkey, ',' ORDER BY k) FROM r WHERE r.o_orderpriority = g.o_orderpriority AND old AND k <= 15), '') AS first_gone
FROM g GROUP BY o_orderpriority""")
def run_changes(spark: SparkSession, d: str) -> DataFrame:
    """Two runs, their scanners being priorities: which customers come and go."""
    orders = table(spark, d, "orders").select("o_orderdate", F.col("o_orderpriority").alias("scanner"), F.col("o_custkey").alias("target_id"), F.concat(F.lit("c"), "o_custkey").alias("display"))
    early = F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")
    told = review.changes(orders.where(early), orders.where(~early))
    return told.withColumns({c: F.array_join(c, ",") for c in ("first_new", "first_gone")})


@query("""WITH r AS (SELECT l_partkey, l_orderkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_suppkey) AS k, count(*) OVER (PARTITION BY l_partkey) AS n FROM (SELECT DISTINCT l_partkey, l_orderkey, l_suppkey FROM lineitem))
SELECT l_partkey, any_value(n) AS n, string_agg(l_orderkey || ':' || l_suppkey, ',' ORDER BY k) FILTER (WHERE k <= 12) AS refs FROM r GROUP BY l_partkey""")
def reference_lists(spark: SparkSession, d: str) -> DataFrame:
    """What refers to each part: orders and suppliers, counted, the first 12 told."""
    told = references.first_references(table(spark, d, "lineitem"), ["l_partkey"], ["l_orderkey", "l_suppkey"], 12)
    return told.withColumn("refs", F.array_join(F.transform("refs", lambda r: F.concat_ws(":", r["l_orderkey"], r["l_suppkey"])), ","))


@query("""WITH l AS (SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events WHERE event_type IN ('error', 'signup')),
m AS (SELECT k, string_agg(event_type, '+' ORDER BY event_type) AS manifests FROM l GROUP BY k),
s AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
h AS (SELECT l_orderkey, string_agg(l_partkey || '=' || manifests, ',' ORDER BY CAST(l_partkey AS VARCHAR)) AS locks FROM s JOIN m ON l_partkey = k GROUP BY l_orderkey)
SELECT o_orderkey, coalesce(locks, '') AS locks FROM orders LEFT JOIN h ON o_orderkey = l_orderkey""")
def locked_findings(spark: SparkSession, d: str) -> DataFrame:
    """Orders are findings, their parts the paths; events are the manifests that lock these."""
    said = table(spark, d, "events").where("event_type IN ('error', 'signup')").select(F.get_json_object("props", "$.k").alias("path"), "event_type")
    locked = said.groupBy("path").agg(F.array_sort(F.collect_set("event_type")).alias("manifests"))
    parts = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("target_id")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("paths"))
    found = table(spark, d, "orders").select(F.lit("orders").alias("scanner"), F.col("o_orderkey").alias("target_id")).join(parts, "target_id", "left").withColumn("paths", F.coalesce("paths", F.array()))
    told = findings.with_locks(found, locked)
    return told.select(F.col("target_id").alias("o_orderkey"), F.array_join(F.transform("locks", lambda k: F.concat(k["path"], F.lit("="), F.array_join(k["manifests"], "+"))), ",").alias("locks"))


@query("""WITH r AS (SELECT DISTINCT l_suppkey, l_linestatus FROM lineitem WHERE l_discount > 0.095), h AS (SELECT * FROM lineitem WHERE l_returnflag = 'R')
SELECT l_suppkey, count(*) FILTER (WHERE x IS NULL) AS kept, count(*) FILTER (WHERE x) AS ignored FROM h LEFT JOIN (SELECT *, true AS x FROM r) USING (l_suppkey, l_linestatus) GROUP BY l_suppkey""")
def suppress_anti(spark: SparkSession, d: str) -> DataFrame:
    """A registry entry covers every hit of its supplier and status."""
    lines = table(spark, d, "lineitem").select("l_suppkey", "l_linestatus", "l_returnflag", "l_discount")
    kept, ignored = findings.suppress(lines.where("l_returnflag = 'R'"), lines.where("l_discount > 0.095D"), ["l_suppkey", "l_linestatus"])
    both = kept.select("l_suppkey", F.lit(1).alias("k"), F.lit(0).alias("i")).unionByName(ignored.select("l_suppkey", F.lit(0).alias("k"), F.lit(1).alias("i")))
    return both.groupBy("l_suppkey").agg(F.sum("k").alias("kept"), F.sum("i").alias("ignored"))


_GRADED = """SELECT o_orderkey, o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'duplicates' WHEN 1 THEN 'regions' WHEN 2 THEN 'contracts' ELSE 'deadcode' END AS scanner,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'HIGH' WHEN o_orderpriority = '2-HIGH' THEN 'medium' END AS priority, CASE WHEN o_orderstatus = 'F' THEN 'medium' END AS severity,
  CASE WHEN o_orderstatus = 'P' THEN 'DEAD' END AS status, CASE o_orderkey % 5 WHEN 0 THEN 'defensive_param_loosening' WHEN 1 THEN 'generation_path_without_env' ELSE 'same_name' END AS channel,
  CASE WHEN o_orderkey % 3 = 0 THEN 'shared_capability' END AS kind, o_totalprice / 500000 AS max_sim, o_orderkey % 7 = 0 AS twin_match FROM orders"""


#: Written out by itself, so that a rung that is wrong in the engine differs.
_RISK = """coalesce(CASE lower(priority) WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' END, CASE lower(severity) WHEN 'high' THEN 'high' WHEN 'medium' THEN 'medium' END, CASE status WHEN 'DEAD' THEN 'high' END,
  CASE WHEN scanner = 'contracts' AND channel IN ('dynamic_module_runtime_coupling', 'defensive_param_loosening', 'env_written_not_read') THEN 'high' WHEN scanner = 'contracts' AND channel = 'generation_path_without_env' THEN 'medium' END)"""
_COHORT = """CASE WHEN (scanner = 'duplicates' AND max_sim >= 0.98) OR (scanner = 'regions' AND twin_match) OR (scanner = 'contracts' AND priority = 'high') THEN 'high'
  WHEN (scanner = 'regions' AND kind = 'shared_capability') OR (scanner = 'contracts' AND priority = 'medium') THEN 'medium' ELSE 'low' END"""


@query(f"SELECT scanner, coalesce({_RISK}, 'none') AS risk, {_COHORT} AS cohort, count(*) AS n FROM ({_GRADED}) GROUP BY ALL")
def severity_cohort(spark: SparkSession, d: str) -> DataFrame:
    graded = findings.graded(spark.sql(_GRADED.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")))
    return graded.groupBy("scanner", F.coalesce("risk", F.lit("none")).alias("risk"), "cohort").agg(F.count("*").alias("n"))


@query(f"""WITH g AS (SELECT *, {_RISK} AS risk FROM ({_GRADED})), now AS (SELECT scanner, o_orderkey AS target_id, o_custkey AS evidence_hash, risk FROM g WHERE o_orderkey % 10 <> 1), before AS (SELECT scanner, o_orderkey AS target_id FROM g WHERE o_orderkey % 10 <> 2),
v AS (SELECT scanner, o_orderkey AS target_id, o_custkey + CASE WHEN o_orderkey % 100 = 0 THEN 1 ELSE 0 END AS reviewed FROM g WHERE o_orderkey % 25 IN (0, 1))
SELECT *, still_present + new_risks = 0 AS passed FROM (SELECT (SELECT count(*) FROM v JOIN now USING (scanner, target_id)) AS still_present, (SELECT count(*) FROM v JOIN now USING (scanner, target_id) WHERE reviewed IS DISTINCT FROM evidence_hash) AS changed,
(SELECT count(*) FROM now WHERE risk IN ('high', 'medium') AND (scanner, target_id) NOT IN (SELECT (scanner, target_id) FROM before)) AS new_risks)""")
def verify_gate_counts(spark: SparkSession, d: str) -> DataFrame:
    graded = findings.graded(spark.sql(_GRADED.replace("FROM orders", "FROM {orders}"), orders=table(spark, d, "orders")))
    every = graded.select("scanner", F.col("o_orderkey").alias("target_id"), F.col("o_custkey").alias("evidence_hash"), "risk")
    verdicts = every.where("target_id % 25 IN (0, 1)").withColumn("evidence_hash", F.expr("evidence_hash + IF(target_id % 100 = 0, 1, 0)"))
    return findings.gate(verdicts, every.where("target_id % 10 <> 2"), every.where("target_id % 10 <> 1"))


# -- scores -------------------------------------------------------------------------------------


@query("""SELECT source, count(*) AS candidates, count(toxic) AS matched, count(*) FILTER (WHERE toxic = 1) AS true_findings,
  round(CASE WHEN count(toxic) = 0 THEN NULL ELSE count(*) FILTER (WHERE toxic = 1) * 1.0 / count(toxic) END, 3) AS precision, round(count(toxic) * 1.0 / count(*), 3) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def label_stats(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "labels").select("doc_id", (F.col("toxic") == 1).alias("is_true"))
    return scoring.label_stats(table(spark, d, "documents").select("doc_id", "source"), labels, ["doc_id"], "source")


@query("""SELECT CASE WHEN n_chars >= 4000 THEN 'high' WHEN n_chars >= 1000 THEN 'medium' ELSE 'low' END AS cohort, count(*) AS candidates, count(quality) AS matched, count(*) FILTER (WHERE quality = 1) AS true_findings,
  round(CASE WHEN count(quality) = 0 THEN NULL ELSE count(*) FILTER (WHERE quality = 1) * 1.0 / count(quality) END, 3) AS precision, round(count(quality) * 1.0 / count(*), 3) AS coverage FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def cohort_precision(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.expr("CASE WHEN n_chars >= 4000 THEN 'high' WHEN n_chars >= 1000 THEN 'medium' ELSE 'low' END").alias("cohort"))
    return scoring.label_stats(docs, table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("is_true")), ["doc_id"], "cohort")


@query("""WITH c AS (SELECT count(*) FILTER (WHERE toxic = 1 AND quality = 0) AS tp, count(*) FILTER (WHERE toxic = 0 AND quality = 0) AS fp, count(*) FILTER (WHERE toxic = 1 AND quality = 1) AS fn, count(*) FILTER (WHERE toxic = 0 AND quality = 1) AS tn FROM labels)
SELECT *, round(CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) END, 3) AS precision, round(CASE WHEN tp + fn > 0 THEN tp * 1.0 / (tp + fn) END, 3) AS recall FROM c""")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return scoring.confusion(table(spark, d, "labels"), F.col("toxic") == 1, F.col("quality") == 0)


@query("""WITH r AS (SELECT n_name, count(*) AS candidates, count(*) FILTER (WHERE s_acctbal > 0) AS labelled, count(*) FILTER (WHERE s_acctbal > 5000) AS found, count(DISTINCT CASE WHEN s_acctbal > 5000 THEN s_suppkey % 3 END) AS issues,
  sum(s_suppkey) AS tokens, CAST(sum(s_suppkey * 7) AS BIGINT) AS lines, count(*) / 4.0 AS seconds FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name),
l AS (SELECT * FROM r WHERE n_name >= 'E'), t AS (SELECT (SELECT count(*) FROM l) AS labelled_projects, (SELECT CAST(coalesce(sum(candidates), 0) AS BIGINT) FROM l) AS candidates, (SELECT CAST(coalesce(sum(labelled), 0) AS BIGINT) FROM l) AS labelled,
  (SELECT CAST(coalesce(sum(found), 0) AS BIGINT) FROM l) AS true_findings, (SELECT CAST(coalesce(sum(labelled - found), 0) AS BIGINT) FROM l) AS false_positives, (SELECT CAST(coalesce(sum(issues), 0) AS BIGINT) FROM l) AS unique_issues,
  (SELECT CAST(coalesce(sum(tokens), 0) AS BIGINT) FROM l) AS estimated_tokens, (SELECT CAST(sum(lines) AS BIGINT) FROM r) AS python_lines, (SELECT CAST(sum(seconds) AS DOUBLE) FROM r) AS elapsed_seconds)
SELECT *, round(true_findings / nullif(labelled, 0)::DOUBLE, 3) AS precision, round(candidates / nullif(true_findings, 0)::DOUBLE, 1) AS review_burden, round(unique_issues / nullif(true_findings, 0)::DOUBLE, 2) AS unique_issue_ratio,
  round(true_findings / nullif(unique_issues, 0)::DOUBLE, 2) AS evidence_per_issue, round(estimated_tokens / nullif(unique_issues, 0)::DOUBLE, 1) AS tokens_per_verified_issue, round(unique_issues / nullif(candidates, 0)::DOUBLE, 4) AS verified_issue_yield,
  round(candidates / greatest(0.001, python_lines / 1000.0)::DOUBLE, 2) AS candidates_per_kloc, round(elapsed_seconds / greatest(0.001, python_lines / 1000.0)::DOUBLE, 3) AS runtime_per_kloc FROM t""")
def corpus_totals(spark: SparkSession, d: str) -> DataFrame:
    """Nations are projects, their suppliers candidates; those before E have no labels."""
    own = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("project"))
    hit = F.col("s_acctbal") > 5000
    rows = own.agg(F.count("*").alias("c"), F.count_if(F.col("s_acctbal") > 0).alias("l"), F.count_if(hit).alias("t"), F.count_distinct(F.when(hit, F.col("s_suppkey") % 3)).alias("u"), F.sum("s_suppkey").alias("k"), F.sum(F.col("s_suppkey") * 7).alias("python_lines"), (F.count("*") / 4.0).alias("elapsed_seconds"))
    labelled = lambda c: F.when(F.col("project") >= "E", F.expr(c))
    named = {"candidates": "c", "labelled": "l", "true_findings": "t", "false_positives": "l - t", "unique_issues": "u", "estimated_tokens": "k"}
    return scoring.totals(rows.select("project", *[labelled(e).alias(n) for n, e in named.items()], "python_lines", "elapsed_seconds"))


_BUNDLES = """m AS (SELECT DISTINCT 'b' || (l_orderkey % 500) AS issue_id, 's' || (l_suppkey % 4) AS scanner, CAST(l_partkey AS VARCHAR) AS target_id FROM lineitem WHERE l_quantity >= 40),
c AS (SELECT issue_id, count(DISTINCT scanner) AS n_channels FROM (SELECT * FROM m WHERE CAST(substr(issue_id, 2) AS INTEGER) % 2 = 0 OR scanner = 's0') GROUP BY issue_id),
members AS (SELECT m.*, n_channels FROM m JOIN c USING (issue_id) WHERE CAST(substr(issue_id, 2) AS INTEGER) % 2 = 0 OR scanner = 's0'),
truth AS (SELECT DISTINCT scanner, target_id, CASE WHEN CAST(target_id AS INTEGER) % 50 = 0 THEN CASE WHEN CAST(target_id AS INTEGER) % 100 = 0 THEN scanner || '/' || target_id ELSE 'i' || target_id END END AS issue FROM m WHERE CAST(target_id AS INTEGER) % 5 = 0),
b AS (SELECT issue_id, max(n_channels) AS n_channels, count(*) AS signals, count(issue) > 0 AS is_true, count(DISTINCT issue) AS n_issues FROM members LEFT JOIN truth USING (scanner, target_id) GROUP BY issue_id)"""


@query(f"""WITH {_BUNDLES}, h AS (SELECT issue, count(DISTINCT issue_id) AS owners, min(issue_id) AS issue_id FROM members JOIN truth USING (scanner, target_id) WHERE issue IS NOT NULL GROUP BY issue),
s AS (SELECT count(*) AS bundles, count(*) FILTER (WHERE n_channels >= 2) AS corroborated, count(*) FILTER (WHERE n_channels >= 2 AND is_true) AS corroborated_true, count(*) FILTER (WHERE n_channels = 1) AS single,
  count(*) FILTER (WHERE n_channels = 1 AND is_true) AS single_true, CAST(sum(signals) AS BIGINT) AS candidates, count(*) FILTER (WHERE n_issues <= 1) AS pure FROM b),
g AS (SELECT count(*) AS ground_truth_issues, count(*) FILTER (WHERE owners = 1 AND n_issues = 1) AS issues_formed FROM h JOIN b USING (issue_id))
SELECT bundles, corroborated, corroborated_true, single, single_true, candidates, ground_truth_issues, issues_formed, round(corroborated_true / nullif(corroborated, 0)::DOUBLE, 3) AS corroborated_precision,
  round(single_true / nullif(single, 0)::DOUBLE, 3) AS single_precision, round(issues_formed / nullif(ground_truth_issues, 0)::DOUBLE, 3) AS issue_recall, round(pure / bundles::DOUBLE, 3) AS fusion_purity, round(candidates / bundles::DOUBLE, 2) AS compression_ratio FROM s, g""")
def fusion_scores(spark: SparkSession, d: str) -> DataFrame:
    return scoring.fusion_scores(*_bundles(spark, d))


def _bundles(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Orders that leave the same by 500 are a bundle, suppliers of one remainder by 4 scanners and parts targets; every fifth part has a label, every fiftieth is a true finding."""
    lines = table(spark, d, "lineitem").where("l_quantity >= 40")
    found = lines.select((F.col("l_orderkey") % 500).alias("n"), F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string")).alias("scanner"), F.col("l_partkey").alias("part")).distinct()
    held = found.where("n % 2 = 0 OR scanner = 's0'")
    channels = held.groupBy("n").agg(F.count_distinct("scanner").alias("n_channels"))
    members = held.join(channels, "n").select(F.concat(F.lit("b"), F.col("n").cast("string")).alias("issue_id"), "n_channels", "scanner", F.col("part").cast("string").alias("target_id"))
    issue = F.when(F.col("part") % 100 != 0, F.concat(F.lit("i"), F.col("part").cast("string")))
    labels = found.where("part % 5 = 0").select("scanner", F.col("part").cast("string").alias("target_id"), (F.col("part") % 50 == 0).alias("is_true"), issue.alias("issue")).distinct()
    return members, labels


@query(f"WITH {_BUNDLES} SELECT n_channels, count(*) AS bundles, count(*) FILTER (WHERE is_true) AS true_bundles, round(count(*) FILTER (WHERE is_true) / count(*)::DOUBLE, 3) AS precision FROM b GROUP BY n_channels")
def precision_by_channels(spark: SparkSession, d: str) -> DataFrame:
    return scoring.by_channel_count(scoring.judged_bundles(*_bundles(spark, d)))


@query("SELECT source, GROUPING(source) = 1 AS total, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY ROLLUP (source)")
def project_rollup(spark: SparkSession, d: str) -> DataFrame:
    return scoring.rollup(table(spark, d, "documents"), "source", {"n": F.count("*"), "chars": F.sum("n_chars")})


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT DISTINCT source, doc_id FROM r WHERE n <= 7 OR i IN (SELECT CAST(floor(k * n / 7.0) AS BIGINT) FROM range(7) t(k))""")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    each = sampling.numbered(table(spark, d, "documents").select("source", "doc_id"), ["source"], ["doc_id"])
    return each.where(sampling.by_stride(F.col("_i"), F.col("_n"), F.lit(7))).drop("_i", "_n")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), x AS (SELECT source, n * 137.0 / (SELECT sum(n) FROM c) AS x FROM c),
r AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, source DESC) AS r FROM x)
SELECT source, CAST(floor(x) + CASE WHEN r <= 137 - (SELECT sum(floor(x)) FROM x) THEN 1 ELSE 0 END AS BIGINT) AS quota FROM r""")
def largest_remainder(spark: SparkSession, d: str) -> DataFrame:
    return sampling.seats(table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")), [], "source", "n", 137).select("source", "quota")


@query("""WITH l AS (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events WHERE event_type IN ('error', 'signup')), m AS (SELECT k, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS manifests FROM l GROUP BY k)
SELECT p_partkey, manifests FROM part LEFT JOIN m ON p_partkey = k""")
def lock_annotate(spark: SparkSession, d: str) -> DataFrame:
    """Parts and the manifests (event types) that name them in their JSON."""
    locks = table(spark, d, "events").where("event_type IN ('error', 'signup')").select(F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type")
    manifests = locks.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("manifests"))
    part = table(spark, d, "part").select("p_partkey")
    return part.join(manifests, part["p_partkey"] == manifests["k"], "left").select("p_partkey", "manifests")


@query("""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents)
SELECT DISTINCT doc_id FROM r JOIN range(333) t(k) ON i = CASE WHEN n <= 333 THEN k ELSE CAST(round_even(k * (n / 333::DOUBLE), 0) AS BIGINT) END WHERE n > 333 UNION SELECT doc_id FROM r WHERE n <= 333""")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.even_sample(table(spark, d, "documents").select("doc_id"), [], ["doc_id"], 333)


_LABELLED = """base AS (SELECT d.source AS project, d.lang AS scanner, lpad(CAST(d.doc_id AS VARCHAR), 12, '0') AS target_id, CASE WHEN l.toxic = 1 THEN 'true_finding' ELSE 'false_positive' END AS label, d.doc_id, d.text, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE d.lang IS NOT NULL AND d.source IS NOT NULL)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as findings: sources are projects, languages scanners, toxic ones true findings."""
    both = table(spark, d, "documents").where("lang IS NOT NULL AND source IS NOT NULL").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id")
    label = F.when(F.col("toxic") == 1, "true_finding").otherwise("false_positive")
    return both.select(F.col("source").alias("project"), F.col("lang").alias("scanner"), F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("target_id"), label.alias("label"), "doc_id", "text", "quality")


@query(f"""WITH {_LABELLED}, b AS (SELECT *, text AS reason FROM base), t AS (SELECT count(*) FILTER (WHERE label = 'true_finding') AS true, greatest(0, 200 - count(*) FILTER (WHERE label = 'true_finding')) AS goal FROM b),
c AS (SELECT project, scanner, count(*) AS n FROM b WHERE label = 'false_positive' GROUP BY ALL), p AS (SELECT project, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY project),
px AS (SELECT project, n, n / (SELECT sum(n) FROM p)::DOUBLE * goal AS x, goal FROM p, t), pr AS (SELECT *, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, project DESC) AS r, goal - sum(floor(x)) OVER () AS left_over FROM px),
pq AS (SELECT project, floor(x) + CASE WHEN r <= left_over THEN 1 ELSE 0 END AS quota FROM pr),
sx AS (SELECT c.project, c.scanner, greatest(0, quota - count(*) OVER w) AS free, c.n / (sum(c.n) OVER w)::DOUBLE * greatest(0, quota - count(*) OVER w) AS x FROM c JOIN pq USING (project) WINDOW w AS (PARTITION BY c.project)),
sr AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY round(x - floor(x), 9) DESC, scanner DESC) AS r, free - sum(floor(x)) OVER (PARTITION BY project) AS left_over FROM sx),
sq AS (SELECT project, scanner, CAST(1 + floor(x) + CASE WHEN r <= left_over THEN 1 ELSE 0 END AS BIGINT) AS quota FROM sr),
f AS (SELECT b.*, quota, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY b.project, b.scanner) AS n FROM b JOIN sq USING (project, scanner) WHERE label = 'false_positive' WINDOW w AS (PARTITION BY b.project, b.scanner ORDER BY target_id)),
kept AS (SELECT DISTINCT project, scanner, target_id, label, reason FROM f, range(1000) k(k) WHERE n <= quota OR (k < quota AND i = floor(k * (n / quota::DOUBLE))))
SELECT project, scanner, target_id, label AS gold_label, 'q' || quality AS issue_id, false AS boundary FROM b WHERE label = 'true_finding'
UNION ALL SELECT project, scanner, kept.target_id, label, NULL, regexp_matches(reason, 'token-level|boilerplate|dunder|overload|coinciden|near-|almost|unrelated') FROM kept""")
def gold_sample(spark: SparkSession, d: str) -> DataFrame:
    """Two hundred of the labelled documents, all the toxic ones among them; their texts are the reasons."""
    labels = _labelled(spark, d).withColumn("reason", F.col("text")).withColumn("issue_id", F.when(F.col("label") == "true_finding", F.concat(F.lit("q"), F.col("quality").cast("string"))))
    return sampling.gold_sample(labels, 200).drop("reason")


@query(f"""WITH {_LABELLED}, now AS (SELECT *, sha256(text) AS evidence_hash FROM base), was AS (SELECT project, scanner, target_id, label, sha256(regexp_replace(text, '[0-9]', '', 'g')) AS evidence_hash, length(text) % 2 = 0 AS human_verified FROM base WHERE quality = 1),
c AS (SELECT project, scanner, count(*) AS n FROM now WHERE label = 'false_positive' GROUP BY ALL), p AS (SELECT project, sum(n) AS of_project FROM c GROUP BY project),
t AS (SELECT CAST(greatest(0, 300 - count(*) FILTER (WHERE label = 'true_finding')) AS DOUBLE) AS budget, greatest(1, count(*) FILTER (WHERE label = 'false_positive')) AS every FROM now),
k AS (SELECT project, scanner, greatest(1.0, round_even(round_even(budget * of_project / every, 0) * n / greatest(1, of_project), 0)) AS cap FROM c JOIN p USING (project), t),
f AS (SELECT now.*, cap, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY now.project, now.scanner) AS n FROM now JOIN k USING (project, scanner) WHERE label = 'false_positive' WINDOW w AS (PARTITION BY now.project, now.scanner ORDER BY target_id)),
chosen AS (SELECT project, scanner, target_id, label, evidence_hash FROM now WHERE label = 'true_finding'
  UNION SELECT project, scanner, target_id, label, evidence_hash FROM f, range(1000) j(j) WHERE n <= cap OR (j < cap AND i = round_even(j * (n / cap), 0))),
m AS (SELECT coalesce(c.project, w.project) AS project, coalesce(c.scanner, w.scanner) AS scanner, coalesce(c.target_id, w.target_id) AS target_id, coalesce(c.label, w.label) AS label, coalesce(c.evidence_hash, w.evidence_hash) AS evidence_hash,
  c.label IS NOT NULL AS chosen, w.human_verified AS was_verified, coalesce(c.evidence_hash <> w.evidence_hash, false) AS stale, w.label IS NOT NULL AS known
  FROM chosen c FULL JOIN was w ON c.project = w.project AND c.scanner = w.scanner AND c.target_id = w.target_id)
SELECT project, scanner, target_id, label, evidence_hash, CASE WHEN stale THEN false ELSE coalesce(was_verified, false) END AS human_verified, CASE WHEN known AND NOT stale THEN 2 ELSE 1 END AS ground_truth_version,
  CASE WHEN known AND NOT stale THEN 'seen' ELSE '' END AS note FROM m WHERE chosen OR was_verified""")
def corpus_sample(spark: SparkSession, d: str) -> DataFrame:
    """Three hundred of the labelled documents, merged with an earlier review of those of good quality, whose evidence had no digits."""
    base = _labelled(spark, d)
    was = base.where("quality = 1").select("project", "scanner", "target_id", "label", F.sha2(F.regexp_replace("text", "[0-9]", ""), 256).alias("evidence_hash"), (F.length("text") % 2 == 0).alias("human_verified"), F.array(F.lit("a")).alias("reviewers"), F.lit(2).alias("ground_truth_version"), F.lit("seen").alias("note"))
    now = base.select("project", "scanner", "target_id", "label", F.sha2("text", 256).alias("evidence_hash"))
    return sampling.corpus_sample(now, was, 300)[0].drop("reviewers")


@query("""WITH c AS (SELECT source AS scanner, doc_id AS target_id, CASE WHEN n_chars >= 4000 THEN 'high' WHEN n_chars >= 1000 THEN 'medium' ELSE 'low' END AS cohort, n_chars // 4 AS tokens FROM documents WHERE n_chars >= 400 AND source IS NOT NULL),
l AS (SELECT source AS scanner, doc_id AS target_id, toxic = 1 AS is_true, CASE WHEN toxic = 1 THEN CASE WHEN quality = 1 THEN 'i' || (doc_id % 20) ELSE source || '/' || doc_id END END AS issue FROM labels JOIN documents USING (doc_id) WHERE source IS NOT NULL AND toxic IS NOT NULL),
b AS (SELECT coalesce(c.scanner, l.scanner) AS scanner, cohort, issue, tokens, c.scanner IS NOT NULL AS found, l.scanner IS NOT NULL AS said, is_true FROM c FULL JOIN l USING (scanner, target_id)),
e AS (SELECT 'all' AS level, NULL AS name, * FROM b UNION ALL SELECT 'scanner', scanner, * FROM b UNION ALL SELECT 'cohort', cohort, * FROM b WHERE cohort IS NOT NULL UNION ALL SELECT 'issue', issue, * FROM b WHERE issue IS NOT NULL)
SELECT level, name, count(*) FILTER (WHERE found) AS candidates, count(*) FILTER (WHERE found AND said) AS labelled, count(*) FILTER (WHERE found AND said AND is_true) AS true_findings, count(*) FILTER (WHERE found AND said AND NOT is_true) AS false_positives,
count(*) FILTER (WHERE said AND NOT found) AS unmatched, count(DISTINCT CASE WHEN found AND said AND is_true THEN issue END) AS unique_issues, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens,
round(count(*) FILTER (WHERE found AND said AND is_true) / nullif(count(*) FILTER (WHERE found AND said), 0)::DOUBLE, 3) AS precision FROM e GROUP BY level, name""")
def label_levels(spark: SparkSession, d: str) -> DataFrame:
    """Documents of 400 characters or more are candidates; toxic ones are true, and those of good quality share an issue by number."""
    docs = table(spark, d, "documents").where("source IS NOT NULL")
    found = docs.where("n_chars >= 400").select(F.col("source").alias("scanner"), F.col("doc_id").alias("target_id"), F.expr("CASE WHEN n_chars >= 4000 THEN 'high' WHEN n_chars >= 1000 THEN 'medium' ELSE 'low' END").alias("cohort"), F.expr("n_chars div 4").alias("tokens"))
    issue = F.when(F.col("quality") == 1, F.concat(F.lit("i"), (F.col("doc_id") % 20).cast("string")))
    said = table(spark, d, "labels").where("toxic IS NOT NULL").join(docs.select("doc_id", "source"), "doc_id")
    return scoring.label_levels(found, said.select(F.col("source").alias("scanner"), F.col("doc_id").alias("target_id"), (F.col("toxic") == 1).alias("is_true"), issue.alias("issue")))


# -- lines ----------------------------------------------------------------------------------------

_LINES = """l AS (SELECT doc_id, i AS line, x[i] AS code FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM (SELECT doc_id, CASE WHEN x[-1] = '' THEN x[:-2] ELSE x END AS x FROM
  (SELECT doc_id, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]') AS x FROM documents WHERE text IS NOT NULL))))"""


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), "text")


@query(f"""WITH {_LINES}, a AS (SELECT doc_id, min(line) AS start_line FROM l WHERE contains(code, 'license') OR contains(code, 'token') GROUP BY doc_id)
SELECT a.doc_id, a.start_line, md5(string_agg('L' || line || ': ' || code || chr(10), '' ORDER BY line)) AS code FROM a JOIN l ON l.doc_id = a.doc_id AND line BETWEEN start_line AND start_line + 29 GROUP BY a.doc_id, a.start_line""")
def line_snippets(spark: SparkSession, d: str) -> DataFrame:
    """Thirty lines of each document from the first on that has one of two words."""
    texts = _texts(spark, d)
    hit = lines.line_table(texts).where(F.contains("code", F.lit("license")) | F.contains("code", F.lit("token")))
    found = hit.groupBy("path").agg(F.min("line").alias("line")).select(F.lit("hardcoded").alias("scanner"), F.col("path").alias("target_id"), F.to_json(F.struct("path", "line")).alias("detail"))
    symbols = spark.createDataFrame([], "path string, qualname string, line int")
    code = lines.snippets(lines.locations(stash(found, "found")), texts, symbols)
    return code.select(F.col("path").cast("bigint").alias("doc_id"), F.col("start_line").cast("bigint").alias("start_line"), F.md5("code").alias("code"))


@query(f"""WITH {_LINES}, e AS (SELECT doc_id + CASE WHEN toxic = 1 THEN 1000000000 ELSE 0 END AS doc_id, 1 + doc_id % 9 AS line, CASE WHEN quality = 1 THEN 'the' ELSE 'der' END AS symbol FROM labels),
n AS (SELECT doc_id, max(line) AS n FROM l GROUP BY doc_id), m AS (SELECT e.doc_id, arg_min(l.line, (abs(l.line - e.line), l.line)) AS moved_to FROM e JOIN l ON l.doc_id = e.doc_id AND contains(l.code, e.symbol) GROUP BY e.doc_id),
r AS (SELECT e.*, CASE WHEN d.doc_id IS NULL THEN 'file missing: ' || e.doc_id WHEN l.line IS NULL THEN 'line ' || e.line || ' gone' WHEN NOT contains(l.code, symbol) THEN 'line ' || e.line || ' no longer defines `' || symbol || '`' END AS reason
  FROM e LEFT JOIN (SELECT doc_id FROM documents WHERE text IS NOT NULL) d USING (doc_id) LEFT JOIN l ON l.doc_id = e.doc_id AND l.line = e.line)
SELECT r.doc_id, r.line, reason, moved_to FROM r LEFT JOIN m USING (doc_id) WHERE reason IS NOT NULL""")
def stale_entries(spark: SparkSession, d: str) -> DataFrame:
    """An entry for each label: a word that a line of its document should have; the documents of toxic ones are elsewhere."""
    own = table(spark, d, "labels").select((F.col("doc_id") + F.when(F.col("toxic") == 1, 1_000_000_000).otherwise(0)).alias("n"), (1 + F.col("doc_id") % 9).alias("line"), F.when(F.col("quality") == 1, "the").otherwise("der").alias("symbol"))
    entries = own.select(F.lit("contracts/word").alias("section"), F.concat_ws(":", F.col("n").cast("string"), F.col("line").cast("string"), "symbol").alias("key"), F.lit(None).cast("string").alias("path"))
    found = lines.stale_places(lines.entry_places(entries), _texts(spark, d))
    return found.select(F.col("path").cast("bigint").alias("doc_id"), F.col("line").cast("bigint").alias("line"), "reason", F.col("moved_to").cast("bigint").alias("moved_to"))


# -- replies and trees ------------------------------------------------------------------------------


@query(r"""WITH c AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'true_finding' WHEN toxic = 1 THEN 'maybe' ELSE 'false_positive' END AS disposition, doc_id % 11 / 10.0 AS confidence, lang || ' "{' || source || '} \' AS reason, toxic FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL AND source IS NOT NULL)
SELECT doc_id, CASE WHEN toxic = 1 AND doc_id % 3 = 0 THEN NULL ELSE disposition END AS disposition, CASE WHEN toxic = 1 AND doc_id % 3 = 0 THEN NULL ELSE confidence::DOUBLE END AS confidence, CASE WHEN toxic = 1 AND doc_id % 3 = 0 THEN NULL ELSE reason END AS reason,
  CASE WHEN toxic = 1 AND doc_id % 3 = 0 THEN 'no object' WHEN disposition = 'maybe' THEN 'disposition' WHEN confidence > 1 THEN 'confidence' WHEN reason IS NULL THEN 'reason' WHEN disposition = 'true_finding' THEN 'a finding needs an action' END AS invalid_reason FROM c""")
def reply_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each labelled document with a verdict in the middle of its text, which has quotes before it and braces after; a third of the toxic ones aren't closed."""
    own = table(spark, d, "labels").join(table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL").select("doc_id", "text", "lang", "source"), "doc_id")
    disposition = F.when(F.col("quality") == 1, "true_finding").when(F.col("toxic") == 1, "maybe").otherwise("false_positive")
    verdict = F.to_json(F.struct(disposition.alias("disposition"), (F.col("doc_id") % 11 / 10).alias("confidence"), F.concat("lang", F.lit(' "{'), "source", F.lit("} \\")).alias("reason")))
    plain = F.translate("text", "{}", "()")
    cut = F.when((F.col("toxic") == 1) & (F.col("doc_id") % 3 == 0), F.regexp_replace(verdict, "}$", "")).otherwise(verdict)
    said = own.withColumn("text", F.concat(plain, F.lit(' so "it is:\n```json\n'), cut, F.lit("\n``` "), F.when(F.col("toxic") == 0, "and {more}, } too ").otherwise(""), plain))
    return records.replies(said.select("doc_id", "text")).select("doc_id", "disposition", "confidence", "reason", "invalid_reason")


@query("""WITH f AS (SELECT source || '/' || lang || '/' || doc_id AS path, source AS a, source || '/' || lang AS b, CAST(doc_id AS VARCHAR) AS name, sha256(text) AS digest, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL),
l AS (SELECT b AS path, a, substr(b, length(a) + 2) AS name, sha256(array_to_string(list(line ORDER BY encode(line)), chr(10))) AS digest, count(*) AS files, sum(size) AS size FROM (SELECT *, name || chr(0) || 'false' || chr(0) || digest AS line FROM f) GROUP BY b, a),
k AS (SELECT a AS path, sha256(array_to_string(list(line ORDER BY encode(line)), chr(10))) AS digest, sum(files) AS files, sum(size) AS size FROM (SELECT *, name || chr(0) || 'true' || chr(0) || digest AS line FROM l) GROUP BY a),
r AS (SELECT '' AS path, sha256(array_to_string(list(line ORDER BY encode(line)), chr(10))) AS digest, sum(files) AS files, sum(size) AS size FROM (SELECT *, path || chr(0) || 'true' || chr(0) || digest AS line FROM k))
SELECT path, CAST(files AS BIGINT) AS files, CAST(size AS BIGINT) AS size, digest FROM (SELECT path, files, size, digest FROM l UNION ALL SELECT * FROM (SELECT path, files, size, digest FROM k) UNION ALL SELECT path, files, size, digest FROM r)""")
def tree_digests(spark: SparkSession, d: str) -> DataFrame:
    """Documents are files of folders of their source and language."""
    docs = table(spark, d, "documents").where("text IS NOT NULL AND source IS NOT NULL AND lang IS NOT NULL")
    files = docs.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.encode("text", "utf-8").alias("content"))
    return trees.tree(stash(trees.file_digests(files), "digests")).where("folder").select("path", "files", "size", "digest")


# -- JSON of any depth -------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_type, user_id, value, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE props IS NOT NULL),
l AS (SELECT event_type, 'props.k' AS pointer, 'number' AS kind, CAST(k AS VARCHAR) AS v FROM e UNION ALL SELECT event_type, 'seen[][].user', 'number', CAST(user_id AS VARCHAR) FROM e WHERE user_id IS NOT NULL
  UNION ALL SELECT event_type, 'seen[][].user', 'null', NULL FROM e WHERE user_id IS NULL UNION ALL SELECT event_type, 'seen[][].tags', 'empty', NULL FROM e UNION ALL SELECT event_type, 'seen[][]', 'string', event_type FROM e)
SELECT event_type, pointer, kind, count(*) AS n, count(DISTINCT v) AS "distinct" FROM l GROUP BY ALL""")
def json_path_counts(spark: SparkSession, d: str) -> DataFrame:
    """Events' properties, put three levels deep beside what else the event says."""
    events = table(spark, d, "events").where("props IS NOT NULL")
    user = F.coalesce(F.col("user_id").cast("string"), F.lit("null"))
    said = F.concat(F.lit('{"props": '), "props", F.lit(', "seen": [[{"user": '), user, F.lit(', "tags": []}, "'), "event_type", F.lit('"]]}'))
    return variants.counts_by_path(variants.leaves(events.select("event_type", said.alias("said")), "said").drop("said"), ["event_type"])
