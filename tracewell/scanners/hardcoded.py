"""Patterns in source that a shared implementation or a parameter should stand for."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import short_hash


@dataclass(frozen=True)
class Pattern:
    name: str
    regex: str
    severity: str
    exclude_paths: tuple[str, ...] = ()


#: The patterns that are looked for by default, and folders besides the usual ones that are left out.
PATTERNS = (
    Pattern("readout_pool_then_ln_inline", r"norm_f\(\s*[A-Za-z_][A-Za-z0-9_]*\.mean\(dim=1\)\s*\)", "high"),
    Pattern("manual_sha256", r"hashlib\.sha256\(", "medium"),
    Pattern("mean_pool_readout_tail", r"\.mean\(dim=1\)", "low"),
)
EXCLUDED = ("tests", "self-audit")
CODE = 160
#: Matches whose places are counted together.
LOT = 64


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def _matches(pattern: Pattern) -> Column:
    """The lines on which matches of the whole text begin. What stands before a match is counted by lots of LOT matches, so that a text of many is read once."""
    found, parts = F.regexp_extract_all("text", F.lit(pattern.regex), F.lit(0)), F.split("text", pattern.regex, -1)
    steps = F.zip_with(parts, found, lambda p, f: F.struct(_breaks(p).alias("before"), F.coalesce(_breaks(f), F.lit(0)).alias("inside")))
    total = lambda some, start: F.aggregate(some, start, lambda a, x: a + x["before"] + x["inside"])

    def placed(every: Column) -> Column:
        lot = lambda k, n: F.slice(every, k * LOT + 1, n)
        sums = F.transform(F.sequence(F.lit(0), F.floor((F.size(every) - 1) / LOT).cast("int")), lambda k: total(lot(k, F.lit(LOT)), F.lit(0)))
        starts = F.aggregate(sums, F.array(F.lit(1)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        of = lambda i: F.floor(i / LOT).cast("int")
        return _once(starts, lambda at: F.transform(every, lambda s, i: s["before"] + total(lot(of(i), i % LOT), F.get(at, of(i)))))

    lines = _once(steps, placed)
    at = F.transform(F.slice(lines, F.lit(1), F.size(found)), lambda n: F.struct(F.lit(pattern.name).alias("pattern"), F.lit(pattern.severity).alias("severity"), n.alias("line")))
    free = ~F.col("path").isin(*pattern.exclude_paths) if pattern.exclude_paths else F.lit(True)
    return F.when(free & F.col("text").rlike(pattern.regex), at).otherwise(F.array().cast("array<struct<pattern:string,severity:string,line:int>>"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), for which value is computed once."""
    return F.transform(F.array(value), use)[0]


def hardcoded(texts: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, every: bool = False, suppressed: DataFrame | None = None) -> DataFrame:
    """(id, path, pattern, severity, line, code): a row for each match. every: those of low severity too. texts: (path, text);
    suppressed: (path, pattern)."""
    sought = [p for p in patterns if every or p.severity != "low"]
    rows = texts.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, EXCLUDED))))
    said = lambda lines: F.transform("m", lambda m: m.withField("code", F.left(F.trim(F.get(lines, m["line"] - 1)), F.lit(CODE))))
    hits = rows.withColumn("m", F.concat(*map(_matches, sought))).where("size(m) > 0")
    hits = hits.select("path", F.explode(_once(F.split("text", "\r?\n"), said)).alias("m")).select("path", "m.*")
    out = hits.select(short_hash("pattern", "path", F.col("line").cast("string"), "code").alias("id"), "path", "pattern", "severity", "line", "code")
    return out if suppressed is None else out.join(suppressed.select("path", "pattern").distinct(), ["path", "pattern"], "left_anti")
