"""Review state that follows a folder of verdicts as files arrive.

    python -m tracewell.streaming.reviews REPORT VERDICTS STATE [--check] [--export FILE --day DAY --owner NAME]

Verdicts are JSON lines. A query of Structured Streaming reads each file once and merges it into a keyed table by (scanner, target_id): the verdict that was given last counts, whatever the order of
files, batches and restarts. A batch that is delivered again after a failure changes nothing. A verdict holds for the evidence that it was given on; when the finding's evidence is
another one, or there is no such finding any more, it no longer counts (`settled` tells the two apart, `settle` drops them).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.review import invalid_reason, pending
from ..sources.keyed import VERDICTS, KeyedTable

KEYS = ["scanner", "target_id"]
FIELDS = [f.split()[0] for f in VERDICTS.split(", ")]


def latest(verdicts: DataFrame) -> DataFrame:
    """The last verdict of each key; of several of one moment the greatest by its columns, so that the result doesn't depend on their order."""
    said = [n for n in FIELDS if n not in (*KEYS, "reviewed_at")]
    best = verdicts.groupBy(*KEYS).agg(F.max(F.struct(F.coalesce("reviewed_at", F.to_timestamp(F.lit("1970-01-01"))).alias("at"), F.struct("reviewed_at", *said).alias("r"))).alias("m"))
    return best.select(*KEYS, "m.r.*").select(*FIELDS)


def merge(table: KeyedTable, verdicts: DataFrame, note: str = "") -> int:
    """Verdicts that keep to the protocol, and skips (which put a finding off), into the table; gives the number of its state."""
    checked = invalid_reason(verdicts)
    kept = checked.where("scanner IS NOT NULL AND target_id IS NOT NULL AND (invalid_reason IS NULL OR disposition = 'skip')").select(*FIELDS)
    return table.change(lambda old: latest(old.select(*FIELDS).unionByName(kept)), note)


def follow(spark: SparkSession, folder: str, table: KeyedTable, checkpoint: str, rejected: str | None = None, files_per_batch: int | None = None) -> StreamingQuery:
    """Start a query that merges the folder's files, those that are there and, until it is stopped, none after them (trigger availableNow): run it again for new ones.
    checkpoint: where the query keeps what it has read. rejected: a folder for the records that break the protocol, with the rule."""
    stream = spark.readStream.schema(VERDICTS)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    name = checkpoint.rstrip("/").rpartition("/")[2]

    def each(batch: DataFrame, number: int) -> None:
        merge(table, batch, f"{name}:{number}")
        if rejected:
            broken = invalid_reason(batch).where("invalid_reason IS NOT NULL AND coalesce(disposition, '') <> 'skip'")
            broken.write.mode("overwrite").json(f"{rejected.rstrip('/')}/batch-{number}")

    return stream.json(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(table: KeyedTable, found: DataFrame) -> DataFrame:
    """The table's verdicts with state: current, changed (the finding's evidence is another one now) or gone. found: scanner, target_id, evidence_hash."""
    now = found.select(*KEYS, F.col("evidence_hash").alias("_now")).dropDuplicates(KEYS)
    state = F.when(F.col("_now").isNull(), "gone").when(F.col("_now") == F.col("evidence_hash"), "current").otherwise("changed")
    return table.read().join(now, KEYS, "left").withColumn("state", state).drop("_now")


def settle(table: KeyedTable, found: DataFrame) -> int:
    """Drop the verdicts that no longer hold."""
    keys = found.select(*KEYS, "evidence_hash").distinct()
    return table.change(lambda old: old.join(keys, [*KEYS, "evidence_hash"], "left_semi"))


def waiting(table: KeyedTable, found: DataFrame) -> DataFrame:
    """The findings that have no verdict on the evidence that they have now; skipped ones wait."""
    return pending(found, table.read())


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracewell.streaming.reviews")
    p.add_argument("report")
    p.add_argument("verdicts")
    p.add_argument("state")
    p.add_argument("--check", action="store_true", help="only tell which findings wait; the exit code is 1 if some do")
    p.add_argument("--export", help="a registry of the false positives, as JSON")
    p.add_argument("--day", default="")
    p.add_argument("--owner", default="")
    said = p.parse_args(args)
    from ..audit import exported, write_text
    from ..session import session
    from ..sources.keyed import verdicts
    from ..sources.records import previous_candidates

    spark = session()
    found = previous_candidates(spark, said.report)
    if found is None:
        p.error(f"{said.report} is no report")
    table = verdicts(spark, f"{said.state}/verdicts")
    if not said.check:
        follow(spark, said.verdicts, table, f"{said.state}/checkpoint", f"{said.state}/rejected").awaitTermination()
    if said.export:
        held = settled(table, found).where("state = 'current'")
        write_text(said.export, json.dumps(exported(held, said.day, said.owner, found), indent=2, ensure_ascii=False) + "\n")
    left = waiting(table, found).select(*KEYS).orderBy(*KEYS)
    n = 0
    for n, r in enumerate(left.toLocalIterator(), 1):
        print(f"{r.scanner}: {r.target_id}")
    return 1 if said.check and n else 0


if __name__ == "__main__":
    raise SystemExit(main())
