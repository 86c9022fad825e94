"""The queries of this package: name to function of (spark, sf_dir), and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cdc, chat, decontam, hard_negatives, langid, license_scan, line_dedup, ngram_join, pii, pivot_topk, simhash_dedup, sp_lattice, spelling
from .common import table


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the rows that aren't held out, and predicts every row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", langid.held_out())
    model = langid.fit(docs.where("NOT held_out"))
    return langid.predict(docs, model, carry=("doc_id", "held_out"))


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows whose vec_id is divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings")
    return pivot_topk.top_k(vectors, vectors.where("vec_id % 50 = 0"), 5)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"), near="grams")


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).drop("detections")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids, and whether they decode to its text."""
    return sp_lattice.encode(table(spark, sf_dir, "documents"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), every=True)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"), wide=True, parts=1).drop("found")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdc.repeats(table(spark, sf_dir, "documents")).drop("rid")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The masks as start:end, comma-joined."""
    parts = chat.rotate(table(spark, sf_dir, "conversations"))
    return parts.withColumn("masks", F.expr("array_join(transform(masks, m -> concat_ws(':', m.start, m.end)), ',')"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose vec_id is divisible by 7 have the next label of ten; anchors are those divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", F.expr("IF(vec_id % 7 = 0, (label + 1) % 10, label)"))
    return hard_negatives.mine(vectors, "id % 100 = 0")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_exact_topk": op2_exact_topk,
    "op3_line_dedup": op3_line_dedup,
    "op4_simhash_near_dedup": op4_simhash_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_benchmark_decontamination": op7_benchmark_decontamination,
    "op8_pii": op8_pii,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_chat_format": op10_chat_format,
    "op11_ngram_join": op11_ngram_join,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op2_exact_topk": pivot_topk.SQL,
    "op10_chat_format": chat.SQL,
    "op11_ngram_join": ngram_join.SQL,
    "op12_spelling_variants": spelling.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
}
