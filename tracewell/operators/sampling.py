"""Rows numbered without one task, samples spread evenly over them, seats given out in proportion, and corpora of findings for review.

`numbered` deals rows out by ranges of their order, numbers each range by itself, and adds what the ranges before it hold; only counts, a row for each range and group, are put in order
together. So a group of any size, or the whole table, is numbered by many tasks. The samples are conditions on these numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import broadcast_if_small, stash

#: Counts of ranges that are sent to every task at most.
BROADCAST_ROWS = 200_000
#: The size of a reviewed corpus and of a gold sample, and words of a reason that mark a near miss.
CORPUS, GOLD = 80, 100
BOUNDARY_WORDS = ("token-level", "boilerplate", "dunder", "overload", "coinciden", "near-", "almost", "unrelated")


def numbered(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows with _i, the number from 0 of a row within its group by the order, and _n, the group's rows. by may be empty: then all rows are one group. A column of the order whose
    name begins with - is descending. Rows that are equal in the order are numbered either way round, so it should end in a key."""
    keys = [F.desc(c[1:]) if c[0] == "-" else F.asc(c) for c in order]
    dealt = stash(rows.repartitionByRange(*[F.col(c) for c in by], *keys).withColumn("_p", F.spark_partition_id()), "dealt")
    own = [F.col(c) for c in by]
    counts = stash(dealt.groupBy(*own, "_p").agg(F.count("*").alias("_c")), "counts")
    group = W.partitionBy(*(own or [F.lit(0)]))
    places = counts.withColumns({"_before": F.sum("_c").over(group.orderBy("_p")) - F.col("_c"), "_n": F.sum("_c").over(group)})
    places = stash(places.select(*[c.alias(f"_by_{i}") for i, c in enumerate(own)], F.col("_p").alias("_by_p"), "_before", "_n"), "places")
    same = F.col("_p") == F.col("_by_p")
    for i, c in enumerate(own):
        same &= c.eqNullSafe(F.col(f"_by_{i}"))
    each = dealt.withColumn("_i", F.row_number().over(W.partitionBy(*own, "_p").orderBy(*keys)) - 1)
    return each.join(broadcast_if_small(places, BROADCAST_ROWS), same).withColumn("_i", (F.col("_i") + F.col("_before")).cast("bigint")).select(*rows.columns, "_i", "_n")


def evenly(i: Column, n: Column, cap: Column) -> Column:
    """Whether row i of n is among cap: those numbered round(j * (n / cap)), halves to even, for j below cap; all if there are no more than cap."""
    step = n.cast("double") / cap
    first = F.floor((i - 0.5) / step).cast("int")
    hit = lambda j: (j >= 0) & (j < cap) & (F.rint(j * step) == i)
    # Only numbers beside i / step can come to i.
    return (n <= cap) | F.exists(F.sequence(first, first + 2), hit)


def by_stride(i: Column, n: Column, quota: Column) -> Column:
    """Whether row i of n is among quota: those numbered floor(j * (n / quota)) for j below quota; all if there are no more than quota."""
    step = n.cast("double") / quota
    first = F.floor(i / step).cast("int")
    hit = lambda j: (j >= 0) & (j < quota) & (F.floor(j * step) == i)
    return (n <= quota) | F.exists(F.sequence(first, first + 1), hit)


def even_sample(rows: DataFrame, by: list[str], order: list[str], cap: Column | int) -> DataFrame:
    """cap rows of each group, spread evenly over its order. cap may be a column."""
    return numbered(rows, by, order).where(evenly(F.col("_i"), F.col("_n"), cap if isinstance(cap, Column) else F.lit(cap))).drop("_i", "_n")


def seats(counts: DataFrame, by: list[str], key: str, n: str, total: Column | int, least: int = 0) -> DataFrame:
    """counts with quota: each group's total of seats in proportion to n, every key having least at first (then even if that is more than the total); what is left after rounding down
    goes to the largest remainders, one each, ties to the larger key. counts: a row for each key of a group, with total as a column where groups differ."""
    group = W.partitionBy(*([F.col(c) for c in by] or [F.lit(0)]))
    sums = counts.groupBy(*by).agg(F.sum(n).alias("_all"), F.count("*").alias("_keys")) if by else counts.agg(F.sum(n).alias("_all"), F.count("*").alias("_keys"))
    sums = stash(sums.select(*[F.col(c).alias(f"_of_{i}") for i, c in enumerate(by)], "_all", "_keys"), "sums")
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_of_{i}"))
    free = F.greatest(F.lit(0), (total if isinstance(total, Column) else F.lit(total)) - F.col("_keys") * least)
    own = counts.join(F.broadcast(sums) if not by else broadcast_if_small(sums, BROADCAST_ROWS), same).withColumn("_free", free.cast("double"))
    own = own.withColumn("_x", F.try_divide(F.col(n), F.col("_all")) * F.col("_free")).withColumn("_q", F.floor("_x")).withColumn("_rest", F.round(F.col("_x") - F.col("_q"), 9))
    own = stash(own.withColumn("_left", F.col("_free") - F.sum("_q").over(group)) if by else own, "seats")
    if not by:
        given = own.agg((F.max("_free") - F.sum("_q")).alias("_left"))
        own = own.join(F.broadcast(given), F.lit(True))
    ranked = numbered(own, by, ["-_rest", f"-{key}"])
    quota = F.lit(least) + F.coalesce("_q", F.lit(0)) + F.when(F.col("_i") < F.col("_left"), 1).otherwise(0)
    return ranked.select(*counts.columns, quota.cast("bigint").alias("quota"))


def gold_sample(labels: DataFrame, size: int = GOLD) -> DataFrame:
    """(project, scanner, target_id, gold_label, issue_id, boundary, reason): every true finding, and false positives up to size: seats for projects in proportion to their false positives, for
    a project's scanners likewise with one each at least, and every k-th target of each. labels: project, scanner, target_id, label, issue_id, reason."""
    labels = stash(labels.where("label IN ('true_finding', 'false_positive')"), "labels")
    true, false = labels.where("label = 'true_finding'"), labels.where("label = 'false_positive'")
    counts = stash(false.groupBy("project", "scanner").agg(F.count("*").alias("n")), "counts")
    projects = seats(counts.groupBy("project").agg(F.sum("n").alias("n")), [], "project", "n", max(0, size - true.count()))
    quotas = counts.join(projects.select("project", F.col("quota").alias("of_project")), "project")
    quotas = stash(seats(quotas, ["project"], "scanner", "n", F.col("of_project"), 1).select("project", "scanner", "quota"), "quotas")
    each = numbered(false, ["project", "scanner"], ["target_id"]).join(broadcast_if_small(quotas, BROADCAST_ROWS), ["project", "scanner"])
    kept = each.where(by_stride(F.col("_i"), F.col("_n"), F.col("quota")))
    near = F.lit(False)
    for word in BOUNDARY_WORDS:
        near |= F.contains("reason", F.lit(word))
    columns = ["project", "scanner", "target_id", F.col("label").alias("gold_label"), "issue_id"]
    return true.select(*columns, F.lit(False).alias("boundary"), "reason").unionByName(kept.select(*columns, F.coalesce(near, F.lit(False)).alias("boundary"), "reason"))


def corpus_sample(candidates: DataFrame, existing: DataFrame, size: int = CORPUS) -> tuple[DataFrame, DataFrame]:
    """The corpus, and (project, scanner, target_id) of what was dropped as stale. candidates: project, scanner, target_id, label, evidence_hash; existing: the same and human_verified,
    reviewers, ground_truth_version, note.

    Every true finding is in it; false positives fill it up to size, in proportion to each project's and scanner's, one of each at least, evenly over their targets. What was reviewed of an entry
    stays, unless its evidence is other than it was; entries that people have verified stay, chosen or not."""
    candidates = stash(candidates.where("label IN ('true_finding', 'false_positive')"), "candidates")
    true, false = candidates.where("label = 'true_finding'"), candidates.where("label = 'false_positive'")
    counts = stash(false.groupBy("project", "scanner").agg(F.count("*").alias("n")), "counts")
    projects = stash(counts.groupBy("project").agg(F.sum("n").alias("of_project")), "projects")
    budget, every = max(0, size - true.count()), projects.agg(F.sum("of_project")).first()[0] or 0
    of_project = F.rint(F.lit(float(budget)) * F.col("of_project") / max(1, every))
    caps = counts.join(projects, "project").select("project", "scanner", F.greatest(F.lit(1.0), F.rint(of_project * F.col("n") / F.greatest(F.lit(1), F.col("of_project")))).alias("cap"))
    caps = stash(caps, "caps")
    each = numbered(false, ["project", "scanner"], ["target_id"]).join(broadcast_if_small(caps, BROADCAST_ROWS), ["project", "scanner"])
    chosen = stash(true.unionByName(each.where(evenly(F.col("_i"), F.col("_n"), F.col("cap"))).select(*true.columns)), "chosen")
    keys = ["project", "scanner", "target_id"]
    was = existing.select(*keys, *[F.col(c).alias(f"_{c}") for c in ("label", "evidence_hash", "human_verified", "reviewers", "ground_truth_version", "note")], F.lit(True).alias("_known"))
    both = stash(chosen.withColumn("_chosen", F.lit(True)).join(was, keys, "full"), "merged")
    stale = F.coalesce(F.col("_chosen") & (F.coalesce("_evidence_hash", F.lit("")) != "") & (F.col("_evidence_hash") != F.col("evidence_hash")), F.lit(False))
    old = lambda c, other: F.when(~stale, F.coalesce(F.col(f"_{c}"), other)).otherwise(other)
    entries = both.where("_chosen OR _human_verified").select(
        *keys, F.coalesce("label", "_label").alias("label"), F.coalesce("evidence_hash", "_evidence_hash").alias("evidence_hash"), old("human_verified", F.lit(False)).alias("human_verified"),
        old("reviewers", F.array().cast("array<string>")).alias("reviewers"), old("ground_truth_version", F.lit(1)).cast("int").alias("ground_truth_version"), old("note", F.lit("")).alias("note"),
    )
    return entries, both.where(stale).select(*keys)
