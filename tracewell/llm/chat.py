"""Chat formatting with rotating perspectives.

A conversation's participants are its roles, but for SYSTEM. For every participant the dialogue is rendered with that speaker as the assistant and
every other as a user with a name; system turns stay system turns. A loss mask covers what the assistant says (text and end mark).

A turn is rendered by itself, from its own row and one participant, so a conversation of any length is spread over tasks; only its
distinct participants are gathered, one row each. The join is dealt by conversation on both sides, so that one with very many turns can
be split. Rendered turns are then put together in parts: part k has the turns numbered TURNS * k to TURNS * k + TURNS - 1. Parts in
order, joined, are the whole dialogue; almost every conversation is one part. A part of over TIED turns, as turns that share a number can make, comes in
several pieces of so many, numbered in order.

The marks of turns can't be forged: within a text or a role every < that begins one is parted from it by a space, and a role's line ends are spaces.

Nulls, empties, ties: rows without a conv_id belong to no conversation and are left out. A null role is the participant UNKNOWN, a null text is
empty, a null turn comes before all others (part -1). Turns with the same number go by role, then text; repeated rows are repeated
turns. A conversation of system turns only has no participant and gives no row. Columns other than the four named play no part. Empty tables give empty
results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stash

SYSTEM, ASSISTANT, USER, UNKNOWN = "system", "assistant", "user", "unknown"
START, END = "<|im_start|>", "<|im_end|>"
TURNS = 64
TIED = 512


def _harmless(column: str, missing: str) -> Column:
    return F.replace(F.coalesce(F.col(column).cast("string"), F.lit(missing)), F.lit("<|im_"), F.lit("< |im_"))


def _numbered(rows: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    """rows with piece, the number of size rows in order within by. A group may be of any size: rows are dealt out by ranges of the order, numbered within
    their range, and what the ranges before hold of the group is added."""
    fixed = stash(rows.withColumn("_tie", F.monotonically_increasing_id()), "tied-rows")
    ranges = max(1, -(-fixed.count() // 100_000))
    dealt = stash(fixed.repartitionByRange(ranges, *by, *order, "_tie").withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = F.row_number().over(W.partitionBy(*by, "_range").orderBy(*order, "_tie"))
    placed = dealt.withColumn("_at", at).join(counts.withColumn("_before", before).drop("_n"), [*by, "_range"])
    return placed.withColumn("piece", ((F.col("_before") + F.col("_at") - 1) / size).cast("int")).drop("_tie", "_range", "_at", "_before")


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, turn, role, name, text, mask, rendered): a row for each turn and participant. name is null for the
    assistant and for system turns; mask is whether the turn is the assistant's."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.translate(_harmless("role", UNKNOWN), "\r\n", "  ").alias("speaker"),
        _harmless("text", "").alias("text"),
    )
    speakers = rows.where(F.col("speaker") != SYSTEM).groupBy("conv_id", "speaker").agg(F.count("*").alias("n")).select(F.col("conv_id").alias("conv"), F.col("speaker").alias("perspective"))
    met = rows.join(stash(speakers, "speakers"), F.col("conv_id") == F.col("conv"))
    mine = F.col("speaker") == F.col("perspective")
    system = F.col("speaker") == SYSTEM
    role = F.when(mine, ASSISTANT).when(system, SYSTEM).otherwise(USER)
    name = F.when(~mine & ~system, F.col("speaker"))
    head = F.concat(F.lit(START), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("\n"))
    return met.select("conv_id", "perspective", "turn", role.alias("role"), name.alias("name"), "text", mine.alias("mask"), head.alias("head"), F.concat(head, F.col("text"), F.lit(END + "\n")).alias("rendered"))


def rotate(conversations: DataFrame) -> DataFrame:
    """(conv_id, perspective, part, piece, n_turns, text, masks): the rendered parts; masks are the stretches that count for the loss, an
    array of (start, end) in code points of text."""
    each = turns(conversations).withColumns({
        "part": F.coalesce(F.floor(F.col("turn") / TURNS), F.lit(-1)).cast("bigint"),
        "row": F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("name", "role").alias("who"), "text", "mask", F.length("head").alias("skip"), "rendered"),
    })
    # Few conversations have turns that share a number; those of one number are counted before they are dealt out.
    tied = each.groupBy("conv_id", "perspective", "part").agg(F.count("*").alias("n")).where(F.col("n") > TIED)
    by = ["conv_id", "perspective", "part"]
    tied = stash(tied.select(*by), "tied")
    each = each.select(*by, "row")
    if tied.isEmpty():
        each = each.withColumn("piece", F.lit(0))
    else:
        many = _numbered(each.join(tied, by, "left_semi"), by, [F.col("row.turn"), F.col("row.who"), F.col("row.text")], TIED)
        each = each.join(tied, by, "left_anti").withColumn("piece", F.lit(0)).unionByName(many.select(*by, "row", "piece"))
    parts = each.groupBy("conv_id", "perspective", "part", "piece").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    spans = """aggregate(rows, named_struct('at', 0, 'out', CAST(array() AS array<struct<start:int,end:int>>)), (s, r) -> named_struct(
        'at', s.at + length(r.rendered),
        'out', IF(r.mask, concat(s.out, array(named_struct('start', s.at + r.skip, 'end', s.at + length(r.rendered) - 1))), s.out))).out"""
    return parts.select("conv_id", "perspective", "part", "piece", F.size("rows").cast("bigint").alias("n_turns"), F.expr("array_join(transform(rows, r -> r.rendered), '')").alias("text"), F.expr(spans).alias("masks"))


#: Of the same rows in DuckDB, where no part has over TIED turns: renderings joined in order, and the masks from running lengths.
SQL = f"""
WITH t AS (
  SELECT conv_id, turn, translate(replace(coalesce(role, '{UNKNOWN}'), '<|im_', '< |im_'), chr(13) || chr(10), '  ') AS speaker, replace(coalesce(text, ''), '<|im_', '< |im_') AS text FROM conversations WHERE conv_id IS NOT NULL
), p AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> '{SYSTEM}'), r AS (
  SELECT conv_id, perspective, turn, speaker, text, speaker = perspective AS mask,
    '{START}' || CASE WHEN speaker = perspective THEN '{ASSISTANT}' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE '{USER} name=' || speaker END || chr(10) AS head
  FROM t JOIN p USING (conv_id)
), o AS (
  SELECT *, coalesce(CAST(floor(turn / {TURNS}.0) AS BIGINT), -1) AS part, head || text || '{END}' || chr(10) AS rendered,
    CASE WHEN mask THEN '{ASSISTANT}' WHEN speaker = '{SYSTEM}' THEN '{SYSTEM}' ELSE speaker END AS who
  FROM r
), w AS (
  SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective, part ORDER BY coalesce(turn, -1), who, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM o
)
SELECT conv_id, perspective, part, 0 AS piece, count(*) AS n_turns,
  string_agg(rendered, '' ORDER BY coalesce(turn, -1), who, text) AS text,
  coalesce(string_agg((pos + length(head)) || ':' || (pos + length(rendered) - 1), ',' ORDER BY pos) FILTER (WHERE mask), '') AS masks
FROM w GROUP BY conv_id, perspective, part
"""
