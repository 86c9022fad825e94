"""Verdict files, one for each case, as a sink of Spark: format "verdict_files".

    spark.dataSource.register(VerdictFiles)
    verdicts.write.format("verdict_files").mode("append").save(folder)

Tasks write their files into a folder of the job, under `_staging`, where no reader looks. The commit names the files of the attempts that succeeded in one list, which appears at once; then they are
moved to their places. So a job that dies before has written nothing, and one that dies while it moves is finished by who comes next (`recover`). A file replaces that of the same case as a whole; files
of other cases stay, whoever writes at the same time.

The folder has to be one that the driver and the executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: The schema of the files, and who writes them.
SCHEMA, ADAPTER = 1, "agent"
STAGING, LIST = "_staging", "committed.json"
VERDICT = ("disposition", "confidence", "reason", "reason_codes", "recommended_action", "reuse_target", "required_verification")


@dataclass
class Written(WriterCommitMessage):
    """(file as staged, its name) of an attempt."""

    files: list[tuple[str, str]]


def content(row: Row) -> dict:
    said = row.asDict(recursive=True)
    out = {"schema_version": SCHEMA, "evidence_hash": said["case_hash"], "adapter": ADAPTER, "created_at": said.get("created_at")}
    out["verdict"] = {k: v for k in VERDICT if (v := said.get(k)) is not None}
    return out | {k: said[k] for k in ("case_hash", "scanner", "target_id", "finding_evidence_hash") if said.get(k) is not None}


class VerdictFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "verdict_files"

    def schema(self) -> str:
        return "case_hash string, scanner string, target_id string, finding_evidence_hash string, disposition string, confidence double, reason string, reason_codes array<string>, recommended_action string, reuse_target string, required_verification array<string>"

    def writer(self, schema: StructType, overwrite: bool) -> VerdictWriter:
        if overwrite:
            raise ValueError("verdict files are added or replaced one by one; use the append mode")
        if "case_hash" not in schema.names:
            raise ValueError("a verdict file is named by its case_hash")
        return VerdictWriter(self.options["path"].removeprefix("file://"))


class VerdictWriter(DataSourceWriter):
    def __init__(self, path: str):
        self.path, self.job = path, uuid.uuid4().hex

    @property
    def staged(self) -> Path:
        return Path(self.path, STAGING, self.job)

    def write(self, iterator: Iterator[Row]) -> Written:
        # Attempts of one task each have their own names.
        attempt, files = uuid.uuid4().hex, []
        self.staged.mkdir(parents=True, exist_ok=True)
        for row in iterator:
            name = row.case_hash
            if not name or not all(c in "0123456789abcdef" for c in name):
                raise ValueError(f"not a hash: {name!r}")
            held = f"{attempt}-{name}.json"
            (self.staged / held).write_text(json.dumps(content(row), indent=2, ensure_ascii=False) + "\n", encoding="utf-8")
            files.append((held, f"{name}.json"))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        # Of several verdicts on one case that of the smallest content stays, whatever the order of tasks.
        best: dict[str, tuple[str, str]] = {}
        for held, name in (f for m in messages if m for f in m.files):
            said = (self.staged / held).read_text(encoding="utf-8")
            best[name] = min(best.get(name, (said, held)), (said, held))
        if best:
            draft = self.staged / f".{LIST}"
            draft.write_text(json.dumps([(held, name) for name, (_, held) in sorted(best.items())]), encoding="utf-8")
            os.replace(draft, self.staged / LIST)
            _finish(Path(self.path), self.staged)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staged, ignore_errors=True)


def _finish(folder: Path, staged: Path) -> None:
    for held, name in json.loads((staged / LIST).read_text(encoding="utf-8")):
        if (staged / held).exists():  # else it was moved before
            os.replace(staged / held, folder / name)
    shutil.rmtree(staged, ignore_errors=True)


def recover(path: str) -> int:
    """Finish what committed jobs have left half moved; gives their number. What was never committed stays where no reader looks, as its job may still run."""
    folder = Path(path.removeprefix("file://"))
    lists = sorted(folder.glob(f"{STAGING}/*/{LIST}"))
    for found in lists:
        _finish(folder, found.parent)
    return len(lists)
