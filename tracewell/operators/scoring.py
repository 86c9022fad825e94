"""Scores against labels, confusion matrices, buckets of reviews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(a: Column | str, b: Column | str, places: int = 3) -> Column:
    """Null where there is nothing to divide by."""
    return F.round(F.try_divide(F.col(a).cast("double") if isinstance(a, str) else a, F.col(b).cast("double") if isinstance(b, str) else b), places)


def label_stats(candidates: DataFrame, labels: DataFrame, keys: list[str], by: str) -> DataFrame:
    """by, candidates, matched, true_findings, precision, coverage. labels: keys and is_true."""
    met = candidates.join(labels.select(*keys, "is_true"), keys, "left")
    own = met.groupBy(by).agg(F.count("*").alias("candidates"), F.count("is_true").alias("matched"), F.count_if("is_true").alias("true_findings"))
    return own.withColumn("precision", share("true_findings", "matched")).withColumn("coverage", share("matched", "candidates"))


def confusion(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    """One row: tp, fp, fn, tn and their rates; null in either counts nowhere."""
    own = rows.select(truth.alias("t"), said.alias("s")).agg(
        F.count_if(F.col("t") & F.col("s")).alias("tp"), F.count_if(~F.col("t") & F.col("s")).alias("fp"), F.count_if(F.col("t") & ~F.col("s")).alias("fn"), F.count_if(~F.col("t") & ~F.col("s")).alias("tn")
    )
    return own.select("*", share(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"), share(F.col("tp").cast("double"), (F.col("tp") + F.col("fn")).cast("double")).alias("recall"))


def rollup(rows: DataFrame, by: str, measures: dict[str, Column]) -> DataFrame:
    """Measures for each value of by, and over all (by null, total true)."""
    own = rows.rollup(by).agg(F.grouping(by).cast("boolean").alias("total"), *[c.alias(n) for n, c in measures.items()])
    return own


def label_levels(candidates: DataFrame, labels: DataFrame) -> DataFrame:
    """(level, name, candidates, labelled, true_findings, false_positives, unmatched, unique_issues, tokens, precision) over everything (level all, name null), each scanner, each
    cohort and each true issue, from one pass. candidates: scanner, target_id, cohort, tokens; labels: scanner, target_id, is_true, issue (null: the label is one by itself).

    unmatched counts labels without a candidate; they belong to no cohort. An issue counts as one of unique_issues if one of its candidates was found; its own row has as labelled the labels of it that
    were found, and as unmatched those that weren't."""
    said = labels.select("scanner", "target_id", "is_true", F.when(F.col("is_true"), F.coalesce("issue", F.concat_ws("/", "scanner", "target_id"))).alias("issue"), F.lit(True).alias("said"))
    both = candidates.select("scanner", "target_id", "cohort", "tokens", F.lit(True).alias("found")).join(said, ["scanner", "target_id"], "full")
    met = F.col("found") & F.col("said")
    hit = F.when(met & F.col("is_true"), F.col("true_issue"))
    both = both.withColumn("true_issue", F.col("issue"))  # the grouping column is null in other levels
    own = both.groupingSets([[], ["scanner"], ["cohort"], ["issue"]], "scanner", "cohort", "issue")
    out = own.agg(
        F.grouping_id().alias("g"), F.count("found").alias("candidates"), F.count_if(met).alias("labelled"), F.count_if(met & F.col("is_true")).alias("true_findings"), F.count_if(met & ~F.col("is_true")).alias("false_positives"),
        F.count_if(F.col("said") & F.col("found").isNull()).alias("unmatched"), F.count_distinct(hit).alias("unique_issues"), F.coalesce(F.sum("tokens"), F.lit(0)).cast("bigint").alias("tokens"),
    )
    level = F.when(F.col("g") == 7, "all").when(F.col("g") == 3, "scanner").when(F.col("g") == 5, "cohort").otherwise("issue")
    out = out.withColumn("level", level).withColumn("name", F.coalesce("scanner", "cohort", "issue")).where("level = 'all' OR name IS NOT NULL")
    counts = ("candidates", "labelled", "true_findings", "false_positives", "unmatched", "unique_issues", "tokens")
    return out.select("level", "name", *counts, share("true_findings", "labelled").alias("precision"))


def totals(results: DataFrame) -> DataFrame:
    """One row of sums and ratios over projects. results: project, candidates, labelled, true_findings, false_positives, unique_issues, estimated_tokens (null for a
    project without labels), python_lines, elapsed_seconds."""
    counted = ("candidates", "labelled", "true_findings", "false_positives", "unique_issues", "estimated_tokens")
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    own = results.agg(F.count("labelled").alias("labelled_projects"), *[zero(F.when(F.col("labelled").isNotNull(), F.col(c))).cast("bigint").alias(c) for c in counted], zero("python_lines").cast("bigint").alias("python_lines"), zero("elapsed_seconds").cast("double").alias("elapsed_seconds"))
    kloc = F.greatest(F.lit(0.001), F.col("python_lines") / 1000.0)
    ratios = {
        "precision": share("true_findings", "labelled"), "review_burden": share("candidates", "true_findings", 1), "unique_issue_ratio": share("unique_issues", "true_findings", 2),
        "evidence_per_issue": share("true_findings", "unique_issues", 2), "tokens_per_verified_issue": share("estimated_tokens", "unique_issues", 1), "verified_issue_yield": share("unique_issues", "candidates", 4),
        "candidates_per_kloc": F.round(F.col("candidates") / kloc, 2), "runtime_per_kloc": F.round(F.col("elapsed_seconds") / kloc, 3),
    }
    return own.withColumns(ratios)


def judged_bundles(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(issue_id, n_channels, signals, is_true, n_issues): the true issues among the members of each bundle. members: (issue_id, n_channels, scanner, target_id);
    labels: (scanner, target_id, is_true, issue); a label without an issue is one by itself."""
    met = members.join(_issues_of(labels), ["scanner", "target_id"], "left")
    return met.groupBy("issue_id").agg(F.max("n_channels").alias("n_channels"), F.count("*").alias("signals"), F.coalesce(F.bool_or("is_true"), F.lit(False)).alias("is_true"), F.count_distinct("true_issue").alias("n_issues"))


def _issues_of(labels: DataFrame) -> DataFrame:
    named = F.coalesce("issue", F.concat_ws("/", "scanner", "target_id"))
    return labels.select("scanner", "target_id", "is_true", F.when(F.col("is_true"), named).alias("true_issue"))


def by_channel_count(bundles: DataFrame) -> DataFrame:
    """(n_channels, bundles, true_bundles, precision). bundles: as judged_bundles gives them."""
    own = bundles.groupBy("n_channels").agg(F.count("*").alias("bundles"), F.count_if("is_true").alias("true_bundles"))
    return own.withColumn("precision", share("true_bundles", "bundles"))


def fusion_scores(members: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: precision of bundles of several channels and of one, the share of true issues that are one bundle by themselves, the share of bundles with one issue at
    most, and signals a bundle."""
    bundles = judged_bundles(members, labels)
    many, one = F.col("n_channels") >= 2, F.col("n_channels") == 1
    own = bundles.agg(
        F.count("*").alias("bundles"), F.count_if(many).alias("corroborated"), F.count_if(many & F.col("is_true")).alias("corroborated_true"), F.count_if(one).alias("single"), F.count_if(one & F.col("is_true")).alias("single_true"),
        F.coalesce(F.sum("signals"), F.lit(0)).alias("candidates"), F.count_if(F.col("n_issues") <= 1).alias("pure"),
    )
    held = members.join(_issues_of(labels), ["scanner", "target_id"]).where("true_issue IS NOT NULL").groupBy("true_issue").agg(F.count_distinct("issue_id").alias("owners"), F.min("issue_id").alias("issue_id"))
    formed = held.join(bundles.select("issue_id", "n_issues"), "issue_id").agg(F.count("*").alias("ground_truth_issues"), F.count_if((F.col("owners") == 1) & (F.col("n_issues") == 1)).alias("issues_formed"))
    both = own.crossJoin(formed)  # one row each
    scores = {
        "corroborated_precision": share("corroborated_true", "corroborated"), "single_precision": share("single_true", "single"), "issue_recall": share("issues_formed", "ground_truth_issues"),
        "fusion_purity": share("pure", "bundles"), "compression_ratio": share("candidates", "bundles", 2),
    }
    return both.withColumns(scores).drop("pure")


def in_corpus(cases: DataFrame, corpus: DataFrame, verified_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """The cases whose finding is in the corpus, with its label; and those that the corpus knows with other evidence. cases: scanner, target_id, evidence_hash;
    corpus: scanner, target_id, evidence_hash (null: any), label, human_verified."""
    known = corpus.where("human_verified") if verified_only else corpus
    met = cases.join(known.select("scanner", "target_id", "label", F.col("evidence_hash").alias("_was")), ["scanner", "target_id"])
    stale = F.coalesce(F.col("_was") != "", F.lit(False)) & (F.col("_was") != F.col("evidence_hash"))
    return met.where(~stale).drop("_was"), met.where(stale).drop("_was", "label")


def review_buckets(cases: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(bucket, n) over cases with a label: agreed, differs, pending (no verdict, or skipped) and invalid. cases: evidence_hash, label; verdicts: evidence_hash,
    disposition, invalid_reason."""
    met = cases.join(verdicts.select("evidence_hash", "disposition", "invalid_reason"), "evidence_hash", "left")
    bucket = F.when(F.col("invalid_reason").isNotNull(), "invalid").when(F.coalesce("disposition", F.lit("skip")) == "skip", "pending").when(F.col("disposition") == F.col("label"), "agreed").otherwise("differs")
    return met.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
