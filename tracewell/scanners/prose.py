"""What TeX prose has too much of, a channel each, in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import short_hash
from ..operators import style
from ..sources.tex import MATH, bare_pm

#: Folders of TeX that no scan enters besides the usual ones, and severities of channels that have one for all.
EXCLUDED = ("frozen", "archive", "legacy")
SEVERITIES = {"template_openers": "medium", "note_that": "low", "excess_vocab": "medium", "em_dash_rate": "medium", "burstiness": "medium", "negative_anaphora": "medium", "pm_format": "low"}


def findings(docs: DataFrame, excluded: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """(id, path, channel, severity, text): docs as sources.tex.documents gives them. Sentences are told by their beginning, measures by their figures."""
    docs = docs.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, excluded))))
    marked = style.sentence_table(docs, "path", "marked")
    said = marked.select("key", "i", "sentence")
    plain = style.sentence_table(docs, "path", "text")
    begin = lambda n: F.left("sentence", F.lit(n))
    parts = [
        style.semicolon_chains(marked).join(said, ["key", "i"]).select("key", F.lit("semicolon_chains").alias("channel"), "severity", begin(220).alias("text")),
        *[hits.join(said, ["key", "i"]).select("key", F.lit(c).alias("channel"), F.lit(SEVERITIES[c]).alias("severity"), begin(160).alias("text")) for c, hits in (("template_openers", style.opener_hits(marked)), ("note_that", style.note_that(marked)))],
        *[
            hits.select("key", F.lit(c).alias("channel"), F.lit(SEVERITIES[c]).alias("severity"), text.alias("text"))
            for c, hits, text in (
                ("excess_vocab", style.excess_vocabulary(docs, "path", "text"), F.format_string("%s x%d", "word", "n")),
                ("negative_anaphora", style.negative_anaphora(docs, "path", "text"), F.format_string("x%d", "n")),
                ("em_dash_rate", style.em_dash_rate(docs, "path", "source", tex=True), F.format_string("%d dashes in %d words", "n_dashes", "n_words")),
                ("burstiness", style.sentence_stats(plain).where("flagged"), F.format_string("%s over %d sentences", F.col("burstiness").cast("string"), "n_sentences")),
                ("pm_format", bare_pm(docs).withColumnRenamed("path", "key"), F.format_string("line %d", "line")),
            )
        ],
    ]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    every = every.withColumn("text", F.replace("text", F.lit(MATH), F.lit(" ")))
    return every.select(short_hash("channel", "key", "text").alias("id"), F.col("key").alias("path"), "channel", "severity", "text")
