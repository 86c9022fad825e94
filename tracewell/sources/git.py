"""What git knows of a tree. Every failure is said to be one: a tree is never taken for clean because git couldn't be asked."""

from __future__ import annotations

import io
import subprocess
import tarfile

from pyspark.sql import DataFrame, SparkSession

UNAVAILABLE = "unavailable"


def _git(root: str, *args: str, text: bool = True):
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=text, check=True, timeout=600).stdout


def provenance(root: str, package: str = ".") -> dict[str, str]:
    """head, and status: clean, dirty or unavailable."""
    try:
        head, changed = _git(root, "rev-parse", "HEAD").strip(), _git(root, "status", "--porcelain", "--", package)
    except (OSError, subprocess.SubprocessError):
        return {"head": UNAVAILABLE, "status": UNAVAILABLE}
    return {"head": head, "status": "dirty" if changed.strip() else "clean"}


def changed_files(spark: SparkSession, root: str, base: str, ending: str = ".py") -> DataFrame:
    """(path), distinct: files that differ from base, and those that git doesn't track yet."""
    names = set(_git(root, "diff", "--name-only", "-z", base, "--", ".").split("\0")) | set(_git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0"))
    return spark.createDataFrame([(n,) for n in sorted(names) if n.endswith(ending)], "path string")


def tree(spark: SparkSession, root: str, ref: str, endings: tuple[str, ...] = (".py",)) -> DataFrame:
    """(path, content): the files of a commit, from one archive. A source tree fits the driver; rows go out in tasks from there."""
    packed = tarfile.open(fileobj=io.BytesIO(_git(root, "archive", "--format=tar", ref, text=False)))
    rows = [(m.name, bytearray(packed.extractfile(m).read())) for m in packed if m.isfile() and m.name.endswith(endings)]
    return spark.createDataFrame(rows, "path string, content binary")
