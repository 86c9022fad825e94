"""Tables of records with keys that several writers change: verdicts by candidate, registries of suppressions.

A table is a folder. Each state of it is a folder of its own, written by tasks through Spark's committer, so that a task that dies leaves nothing behind that counts; it becomes the table's state by the creation of one
small file, its number in `_states`, which only one writer can do. Who comes second reads the new state and merges again, so no writer's records are lost, and a reader sees a merge whole or not at
all. States before the last KEPT are deleted, as readers of those may still be at work.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..operators.findings import first_record_wins, upsert

#: States that stay, the last one among them, and times that a merge is tried.
KEPT, TRIES = 3, 20


class Conflict(RuntimeError):
    """Other writers came first, every time."""


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), StructType.fromDDL(schema), keys

    def _fs(self, path: str):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _local(self, path: str) -> str | None:
        """The path without a scheme, if it is a folder that this machine sees as files."""
        fs, where = self._fs(path)
        return fs.makeQualified(where).toUri().getPath() if fs.getScheme() == "file" else None

    def states(self) -> list[tuple[int, str, str]]:
        """(number, folder, note) of every state that counts, in order."""
        fs, where = self._fs(f"{self.path}/_states")
        if not fs.exists(where):
            return []
        # A state's file is named <number>; what is in it came with its creation.
        numbers = sorted(int(n) for s in fs.listStatus(where) if (n := s.getPath().getName()).isdigit())
        return [(n, *self._said(n)) for n in numbers]

    def _said(self, number: int) -> tuple[str, str]:
        row = self.spark.read.text(f"{self.path}/_states/{number}", wholetext=True).first()
        folder, _, note = row.value.partition("\n")
        return folder, note

    def _claim(self, number: int, folder: str, note: str) -> bool:
        """Make the folder state number; False if there is one already. The file is written whole beside its place first, and put there by an operation that fails if the place is taken."""
        target, draft = f"{self.path}/_states/{number}", f"{self.path}/_states/.{uuid.uuid4().hex}"
        said = f"{folder}\n{note}".encode()
        fs, where = self._fs(f"{self.path}/_states")
        fs.mkdirs(where)
        if local := self._local(target):
            draft = self._local(draft)
            with open(draft, "wb") as f:
                f.write(said)
            try:
                os.link(draft, local)
                return True
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
        fs, beside = self._fs(draft)
        out = fs.create(beside, True)
        out.write(said)
        out.close()
        # Stores with a rename that fails where the target is: HDFS and its like.
        done = not fs.exists(self._fs(target)[1]) and fs.rename(beside, self._fs(target)[1])
        fs.delete(beside, False)
        return done

    def read(self, number: int | None = None) -> DataFrame:
        """The last state, or that with this number; without any the table is empty."""
        found = [s for s in self.states() if number is None or s[0] == number]
        if not found:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/{found[-1][1]}")

    def change(self, merged: Callable[[DataFrame], DataFrame], note: str = "") -> int:
        """Replace the state by what merged makes of it; gives the new state's number. A note that some state already has means that this change was made before: then nothing is done, so that a
        batch that is delivered again changes nothing."""
        for _ in range(TRIES):
            states = self.states()
            if note and any(n == note for *_, n in states):
                return states[-1][0]
            number, folder = (states[-1][0] if states else 0), f"state-{uuid.uuid4().hex}"
            try:
                merged(self.read(number or None)).select(*self.schema.names).write.parquet(f"{self.path}/{folder}")
            except BaseException:
                self._drop(folder)
                raise
            if self._claim(number + 1, folder, note):
                self._tidy()
                return number + 1
            self._drop(folder)
        raise Conflict(self.path)

    def _drop(self, folder: str) -> None:
        fs, where = self._fs(f"{self.path}/{folder}")
        fs.delete(where, True)

    def _tidy(self) -> None:
        """Folders of states before the last KEPT go. Their numbers stay, for notes that come again."""
        for _, folder, _note in self.states()[:-KEPT]:
            self._drop(folder)

    def upsert(self, new: DataFrame, note: str = "") -> int:
        """new's records in place of those of the same keys; of several of a key in new one counts, the greatest by its columns."""
        one = new.select(*self.schema.names).groupBy(*self.keys).agg(_greatest([n for n in self.schema.names if n not in self.keys]))
        one = one.select(*self.keys, "_r.*").select(*self.schema.names)
        return self.change(lambda old: upsert(old, one, self.keys), note)

    def add(self, new: DataFrame, note: str = "") -> int:
        """Those of new's records whose keys the table lacks: the first record of a key stays."""
        return self.change(lambda old: first_record_wins(old, new.select(*self.schema.names), self.keys), note)


def _greatest(columns: list[str]):
    from pyspark.sql import functions as F

    return F.max(F.struct(*columns)).alias("_r")


#: Verdicts by candidate, and suppressions by what they suppress.
VERDICTS = "scanner string, target_id string, evidence_hash string, reviewed_at timestamp, disposition string, confidence double, reason string, reason_codes array<string>, recommended_action string, reuse_target string, required_verification array<string>"
SUPPRESSIONS = "section string, target_id string, pattern string, reason string, day string, owner string"


def verdicts(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, VERDICTS, ["scanner", "target_id"])


def suppressions(spark: SparkSession, path: str) -> KeyedTable:
    """A suppression's pattern is the empty string where its section has none, since keys are compared."""
    return KeyedTable(spark, path, SUPPRESSIONS, ["section", "target_id", "pattern"])
