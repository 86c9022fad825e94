"""Prose metrics over documents and their sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import sentences, words

#: Fixed values.
EXCESS_VOCAB = ("additionally", "moreover", "furthermore", "delve", "leverage", "utilize", "pivotal", "crucial", "notably", "significant", "robust")
TEMPLATE_OPENERS = ("However", "Moreover", "Furthermore", "Additionally", "In summary", "Notably", "Specifically", "Importantly", "Overall", "In conclusion")
STAT_TOKENS = r"(?i)\b(p[- ]?value|p[{]=[}]?|CI|confidence|std|sd|mean|accuracy|error|variance|statistic|t[- ]?stat|F[- ]?stat|n[{]=[}]|dof|p[{]<[}]|p[{]>[}])\b"
EM_DASHES_PER_100, LEAST_BURSTINESS = 0.5, 0.4


def sentence_table(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, sentence, n_words)"""
    cut = docs.select(F.col(key).alias("key"), F.posexplode(sentences(text)).alias("i", "sentence"))
    return cut.withColumn("n_words", F.size(words("sentence")))


def deviation(numbers: str) -> str:
    """The population deviation of an array of doubles, as SQL, by one running sum in the array's order. So its last bit is the same however the rows were grouped, and as DuckDB's
    sum has it: a ratio of just 0.4 stands on it."""
    step = "(s, x) -> named_struct('n', s.n + 1D, 'm', s.m + (x - s.m) / (s.n + 1D), 'd', s.d + (x - (s.m + (x - s.m) / (s.n + 1D))) * (x - s.m))"
    return f"aggregate({numbers}, named_struct('n', 0D, 'm', 0D, 'd', 0D), {step}, s -> IF(s.n > 1D, sqrt(s.d / s.n), 0D))"


def sentence_stats(table: DataFrame) -> DataFrame:
    """(key, n_sentences, mean_words, sd_words, burstiness, flagged); population deviation, and one sentence alone is always flagged."""
    numbers = F.transform(F.array_sort(F.collect_list(F.struct("i", "n_words"))), lambda x: x["n_words"].cast("double"))
    own = table.groupBy("key").agg(F.count("*").alias("n_sentences"), F.avg("n_words").alias("m"), numbers.alias("numbers")).withColumn("s", F.expr(deviation("numbers")))
    burst = F.coalesce(F.try_divide("s", "m"), F.lit(0.0))
    return own.select("key", "n_sentences", F.round("m", 4).alias("mean_words"), F.round("s", 4).alias("sd_words"), F.round(burst, 4).alias("burstiness"), (burst < LEAST_BURSTINESS).alias("flagged"))


def overall_burstiness(table: DataFrame) -> DataFrame:
    """One row over all sentences, not a mean of documents."""
    own = table.agg(F.count("*").alias("n_sentences"), F.sum("n_words").alias("n_words"), F.avg("n_words").alias("m"), F.stddev_pop("n_words").alias("s"))
    return own.select("n_sentences", "n_words", F.round(F.try_divide("s", "m"), 6).alias("burstiness"))


def semicolon_chains(table: DataFrame) -> DataFrame:
    """(key, i, subclauses, triad_like, technical, severity) of sentences of three subclauses or more."""
    parts = F.filter(F.transform(F.split("sentence", ";"), lambda p: F.trim(p)), lambda p: p != "")
    cut = table.withColumn("parts", parts).where("size(parts) >= 3").withColumn("sizes", F.transform("parts", lambda p: F.size(words(F.replace(p, F.lit(" [MATH] "), F.lit(" ")))).cast("double")))
    mean = F.expr("aggregate(sizes, 0D, (a, x) -> a + x) / size(sizes)")
    cut = cut.withColumn("m", mean).withColumn("s", F.expr(deviation("sizes")))
    cut = cut.withColumn("triad_like", F.expr("m > 0 AND s / nullif(m, 0) < 0.45D")).withColumn("technical", F.expr("size(filter(parts, p -> p RLIKE '[0-9]|\\\\[MATH\\\\]')) >= 0.5D * size(parts)"))
    triad = F.coalesce("triad_like", F.lit(False))
    return cut.select("key", "i", F.size("parts").alias("subclauses"), triad.alias("triad_like"), "technical", F.when(triad & ~F.col("technical"), "high").otherwise("medium").alias("severity"))


def opener_hits(table: DataFrame, openers: tuple[str, ...] = TEMPLATE_OPENERS) -> DataFrame:
    """(key, i, opener) of sentences that begin with one, in its case, and go on with white space or a comma."""
    found = F.regexp_extract("sentence", r"^(" + "|".join(openers) + r")[,\s]", 1)
    return table.select("key", "i", found.alias("opener")).where("opener <> ''")


def note_that(table: DataFrame) -> DataFrame:
    return table.where(F.col("sentence").rlike(r"(?i)^note that\b")).select("key", "i")


def excess_vocabulary(docs: DataFrame, key: str, text: str, vocabulary: tuple[str, ...] = EXCESS_VOCAB) -> DataFrame:
    """(key, word, n): occurrences of each word but those of significant and robust that a statistical term follows within 80 characters, or,
    after robust, a preposition."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("t"), F.explode(F.array(*map(F.lit, vocabulary))).alias("word"))
    rows = rows.where(F.contains(F.lower("t"), F.col("word")))
    tails = F.slice(F.split("t", F.concat(F.lit(r"(?i)\b"), F.col("word"), F.lit(r"\b")), -1), 2, 1 << 30)
    # A tail ends where the next occurrence begins: it is read on through as many as 80 characters can hold.
    rows = rows.withColumn("tails", tails)
    ahead = F.transform("tails", lambda _, i: F.array_join(F.slice("tails", i + 1, F.lit(20)), "word")) if any(w in vocabulary for w in ("significant", "robust")) else F.col("tails")
    exempt = F.col("word").isin("significant", "robust")
    technical = lambda x: F.substring(x, 1, 80).rlike(STAT_TOKENS) | ((F.col("word") == "robust") & F.substring(x, 1, 80).rlike(r"\b(?:to|against|w[.]?r[.]?t[.]?)\b"))
    kept = F.filter(ahead, lambda x: ~(exempt & technical(x)))
    return rows.select("key", "word", F.size(kept).alias("n")).where("n > 0")


def em_dash_rate(docs: DataFrame, key: str, text: str, least: float = EM_DASHES_PER_100, tex: bool = False) -> DataFrame:
    """(key, n_dashes, n_words, per_100) of documents at or over the rate. tex: whether three hyphens count as well."""
    own = docs.select(F.col(key).alias("key"), F.regexp_count(text, F.lit("---|—" if tex else "—")).alias("n_dashes"), F.size(words(text)).alias("n_words"))
    rate = F.coalesce(F.try_divide(F.col("n_dashes") * 100.0, "n_words"), F.lit(0.0))
    return own.withColumn("per_100", F.round(rate, 4)).where(rate >= least)


def negative_anaphora(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n)"""
    n = F.regexp_count(text, F.lit(r"(?i)\bnot just\b[^.!?]{0,140}?EMDASH|\bnot only\b[^.!?]{0,140}?\bbut\b"))
    return docs.select(F.col(key).alias("key"), n.alias("n")).where("n > 0")


def pattern_hits(docs: DataFrame, key: str, text: str, patterns: dict[str, str]) -> DataFrame:
    """(key, pattern, line, hit): every match of every pattern, with its line from 1. patterns: a few, by name."""
    lines = docs.select(F.col(key).alias("key"), F.posexplode(F.split(text, "\n")).alias("i", "line_text"))

    def hits(name: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all("line_text", F.lit(pattern), F.lit(0)), lambda x: F.struct(F.lit(name).alias("pattern"), x.alias("hit")))

    found = F.concat(*[hits(n, p) for n, p in patterns.items()])
    return lines.select("key", (F.col("i") + 1).alias("line"), F.explode(found).alias("h")).select("key", "h.pattern", "line", "h.hit")
