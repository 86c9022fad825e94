"""Source lines as a table, and what is looked up in it: code around findings, entries of a registry that no longer fit, lines that have moved.

A line's bin is its number by BIN; a stretch of up to BIN lines lies in two bins at most, so stretches meet lines by an equi-join on (path, bin) and a comparison, however many stretches a
file has. Only files that are asked for are cut into lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.tables import broadcast_if_small, stash

#: Lines of a snippet, and files of a finding that snippets are taken from.
SNIPPET, FILES = 30, 4
BIN = SNIPPET
BROADCAST_ROWS = 200_000
#: What ends a line.
ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def split_lines(text: Column | str) -> Column:
    """A text's lines; nothing follows the last line's end, and an empty text has none."""
    cut = F.split(text, ENDS, -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, F.lit(1), F.size(cut) - 1)).otherwise(cut)


def line_table(texts: DataFrame) -> DataFrame:
    """(path, line from 1, bin, code, line_hash) of texts (path, text). line_hash is the SHA-256 of the line without the space around it, so that a line which is only indented anew
    keeps its own."""
    each = texts.select("path", F.posexplode(split_lines("text")).alias("i", "code"))
    return each.select("path", (F.col("i") + 1).alias("line"), F.expr(f"i div {BIN}").alias("bin"), "code", F.sha2(F.trim("code"), 256).alias("line_hash"))


def within(stretches: DataFrame, lines: DataFrame) -> DataFrame:
    """stretches (path, first, last, ...) with line, code and line_hash of each line in them: an interval join. No stretch may be longer than BIN lines."""
    bins = F.explode(F.array_distinct(F.array(F.expr(f"(first - 1) div {BIN}"), F.expr(f"(last - 1) div {BIN}")))).alias("bin")
    asked = stretches.select("*", bins)
    return asked.join(lines, ["path", "bin"]).where("line BETWEEN first AND last").drop("bin")


def _asked(texts: DataFrame, asks: DataFrame) -> DataFrame:
    return texts.join(broadcast_if_small(stash(asks.select("path").where("path IS NOT NULL").distinct(), "paths"), BROADCAST_ROWS), "path", "left_semi")


def locations(found: DataFrame) -> DataFrame:
    """(scanner, target_id, n, path, qualname, line): where a candidate's code is, FILES places at most. found: scanner, target_id, detail (JSON of the scanner's row).

    Clusters name members as path:qualname, with #n for one of several of that name or :first-last for a region; forks name two in key, capabilities the local one; others have a path and perhaps a
    line, and the name or the module that they are about."""
    schema = "members array<string>, key string, local string, path string, qualname string, name string, module string, line int"
    d = found.select("scanner", "target_id", F.from_json("detail", schema).alias("d")).select("scanner", "target_id", "d.*")
    many = F.when(F.col("members").isNotNull(), F.col("members")).when(F.col("key").contains("::"), F.split("key", "::")).when(F.col("local").isNotNull(), F.array("local"))
    parts = lambda m: F.split(m, ":")
    bare = lambda m: F.regexp_replace(F.get(parts(m), F.lit(1)), "#[0-9]+$", "")
    first = lambda m: F.regexp_extract(m, ":([0-9]+)-[0-9]+$", 1).try_cast("int")
    place = lambda m: F.struct(F.get(parts(m), F.lit(0)).alias("path"), F.when(first(m).isNull(), bare(m)).alias("qualname"), first(m).alias("line"))
    alone = F.array(F.struct("path", F.coalesce("qualname", "name", "module").alias("qualname"), "line"))
    each = d.select("scanner", "target_id", F.posexplode(F.slice(F.coalesce(F.transform(many, place), alone), F.lit(1), F.lit(FILES))).alias("n", "x"))
    return each.select("scanner", "target_id", "n", "x.path", "x.qualname", "x.line").where("path <> ''")


def snippets(places: DataFrame, texts: DataFrame, symbols: DataFrame, length: int = SNIPPET) -> DataFrame:
    """(scanner, target_id, n, path, qualname, start_line, code, error): up to length lines from each place on, each as `L<number>: <line>` with a newline. places: as locations gives
    them; texts: (path, text); symbols: (path, qualname, line). A name that a file has decides; else the place's own line does. error says that the file isn't there, or the place."""
    defined = symbols.groupBy("path", "qualname").agg(F.min("line").alias("at"))
    texts = _asked(texts, places)
    there = stash(texts.select("path").withColumn("there", F.lit(True)), "there")
    own = places.join(broadcast_if_small(there, BROADCAST_ROWS), "path", "left").join(defined, ["path", "qualname"], "left")
    own = own.withColumn("first", F.coalesce("at", "line")).withColumn("last", F.col("first") + length - 1)
    own = stash(own.select("scanner", "target_id", "n", "path", "qualname", "there", "first", "last"), "places")
    key = ["scanner", "target_id", "n"]
    met = within(own.where("there AND first IS NOT NULL").select(*key, "path", "first", "last"), line_table(texts))
    said = F.sort_array(F.collect_list(F.struct("line", F.format_string("L%d: %s\n", "line", "code").alias("text"))))
    code = met.groupBy(*key).agg(F.array_join(F.transform(said, lambda x: x["text"]), "").alias("code"))
    error = F.when(F.col("there").isNull(), "file not found").when(F.col("first").isNull(), "location not found")
    out = own.join(code, key, "left").withColumn("error", error)
    return out.select(*key, "path", "qualname", F.when(F.col("error").isNull(), F.col("first")).alias("start_line"), F.when(F.col("error").isNull(), F.coalesce("code", F.lit(""))).alias("code"), "error")


def entry_places(entries: DataFrame) -> DataFrame:
    """(section, key, path, line, symbol): the places that entries of a registry name. entries: section, key, path.

    Keys of contracts and capabilities are path, path:line, path:line:symbol or path:symbol; those of forks are two of them, of which only the paths count; of other sections the
    path itself counts. A cluster's id names no place."""
    parts = F.split("half", ":")
    second = F.get(parts, F.lit(1))
    numbered = F.coalesce(second.rlike("^[0-9]+$"), F.lit(False))
    placed = F.col("section").startswith("contracts/") | (F.col("section") == "capabilities")
    halves = F.when(F.col("section") == "forks", F.split("key", "::")).when(placed, F.array("key")).otherwise(F.array("path"))
    each = entries.withColumn("half", F.explode(halves)).where("half <> ''")
    line = F.when(F.col("section").startswith("contracts/") & numbered, second.try_cast("int"))
    symbol = F.when(placed, F.when(numbered, F.get(parts, F.lit(2))).otherwise(second))
    return each.select("section", F.coalesce("key", "path").alias("key"), F.when(placed | (F.col("section") == "forks"), parts[0]).otherwise(F.col("half")).alias("path"), line.alias("line"), symbol.alias("symbol"))


def stale_places(places: DataFrame, texts: DataFrame) -> DataFrame:
    """(section, key, path, line, symbol, reason, moved_to): entries whose file is gone, whose line is, or whose symbol isn't where they say. places: as entry_places gives them, perhaps with line_hash, that
    of the line when it was reviewed. moved_to: the nearest line of the file that is the reviewed line, or, where no hash is known, has the symbol; null if there is none."""
    if "line_hash" not in places.columns:
        places = places.withColumn("line_hash", F.lit(None).cast("string"))
    places = stash(places.withColumn("_id", F.monotonically_increasing_id()), "places")
    texts = stash(_asked(texts, places), "texts")
    sizes = texts.select("path", F.size(split_lines("text")).alias("n_lines"))
    own = places.join(sizes, "path", "left")
    here = within(places.where("line >= 1").select("_id", "path", F.col("line").alias("first"), F.col("line").alias("last")), line_table(texts)).select("_id", F.col("code").alias("_code"), F.col("line_hash").alias("_hash"))
    own = own.join(here, "_id", "left")
    whole = places.where("line IS NULL AND symbol IS NOT NULL").select("_id", "path", "symbol").join(texts, "path").select("_id", F.contains("text", F.col("symbol")).alias("_held"))
    own = own.join(whole, "_id", "left")
    other = (F.col("symbol").isNotNull() & ~F.contains("_code", F.col("symbol"))) | (F.col("line_hash").isNotNull() & (F.col("_hash") != F.col("line_hash")))
    reason = F.when(F.col("n_lines").isNull(), F.concat(F.lit("file missing: "), "path")).when(F.col("line").isNotNull(),
        F.when(F.col("_code").isNull(), F.format_string("line %d gone", "line")).when(other, F.when(F.col("symbol").isNotNull(), F.format_string("line %d no longer defines `%s`", "line", "symbol")).otherwise(F.format_string("line %d has changed", "line")))
    ).when(F.col("symbol").isNotNull() & ~F.coalesce("_held", F.lit(False)), F.format_string("symbol `%s` gone", "symbol"))
    lost = stash(own.withColumn("reason", reason).where("reason IS NOT NULL"), "stale")
    sought = lost.where("n_lines IS NOT NULL AND line IS NOT NULL AND (line_hash IS NOT NULL OR symbol IS NOT NULL)").select("_id", "path", F.col("line").alias("_line"), "symbol", F.col("line_hash").alias("_was"))
    lines = line_table(_asked(texts, sought))
    same = lines.join(sought.where("_was IS NOT NULL"), (lines["path"] == sought["path"]) & (lines["line_hash"] == F.col("_was"))).select("_id", "_line", "line")
    held = sought.where("_was IS NULL").join(texts, "path").select("_id", "_line", F.posexplode(split_lines("text")).alias("i", "code"), "symbol").where(F.contains("code", F.col("symbol"))).select("_id", "_line", (F.col("i") + 1).alias("line"))
    near = same.unionByName(held).groupBy("_id").agg(F.min(F.struct(F.abs(F.col("line") - F.col("_line")).alias("far"), "line")).alias("m"))
    return lost.join(near, "_id", "left").select("section", "key", "path", "line", "symbol", "reason", F.col("m.line").alias("moved_to"))


def carried(before: DataFrame, now: DataFrame) -> DataFrame:
    """(path, line, now_line): lines of one state of some files that stand in another state of them, by content: the k-th of equal lines of a file goes to the k-th. before and now: line tables."""
    same = W.partitionBy("path", "line_hash").orderBy("line")
    nth = lambda lines, name: lines.select("path", F.col("line").alias(name), "line_hash", F.row_number().over(same).alias("k"))
    return nth(before, "line").join(nth(now, "now_line"), ["path", "line_hash", "k"]).select("path", "line", "now_line")


#: What is told of a candidate in one line, as labels and fields of its scanner's row.
EVIDENCE = {
    "deadcode": {"status": "status", "py_refs": "py_refs", "doc_refs": "doc_refs"},
    "duplicates": {"priority": "priority", "reason": "priority_reason"},
    "regions": {"kind": "kind", "priority": "priority", "risk": "semantic_risk", "signals": "risk_signals", "canonical": "canonical"},
    "forks": {"sim": "similarity", "kind": "kind", "sig": "signature_match", "left": "key", "right": "key"},
    "capabilities": {"match": "match", "sig": "signature_match", "local": "local", "lib": "lib"},
    "hardcoded": {"pattern": "pattern", "code": "code", "hint": "suggestion"},
    "style": {"metric": "channel", "text": "text"},
}
#: Characters of a contract's row, which is told as it is.
TOLD = 400


def evidence_lines(found: DataFrame) -> DataFrame:
    """found (scanner, target_id, detail, ...) with evidence, one line for a reviewer: label=field, None for a field that the row lacks; of contracts the row itself."""
    row = F.from_json("detail", "map<string,string>")
    sides = lambda i: F.get(F.split(row["key"], "::"), F.lit(i))
    signals = F.coalesce(F.nullif(F.array_join(F.from_json(row["risk_signals"], "array<string>"), ","), F.lit("")), F.lit("-"))
    told = {("regions", "signals"): signals, ("regions", "canonical"): F.coalesce(row["canonical"], F.lit("none")), ("forks", "left"): sides(0), ("forks", "right"): sides(1)}
    line = F.when(F.col("scanner") == "contracts", F.left("detail", F.lit(TOLD)))
    for scanner, fields in EVIDENCE.items():
        parts = [F.concat(F.lit(f"{label}="), F.coalesce(told.get((scanner, label), row[field]), F.lit("None"))) for label, field in fields.items()]
        line = line.when(F.col("scanner") == scanner, F.concat_ws(" ", *parts))
    return found.withColumn("evidence", F.coalesce(line, F.lit("")))
