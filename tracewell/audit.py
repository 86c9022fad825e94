"""A whole audit of a project: every scanner, one table of candidates, issues, a JSON and a Markdown report.

    python -m tracewell.audit ROOT [--package NAME] [--json FILE] [--markdown FILE] [--suppress FILE] [--all] [--snippets FOLDER] [--previous REPORT]
"""

from __future__ import annotations

import argparse
import json
import os
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config
from .functions.ids import with_evidence_hash
from .operators import findings, lines, review
from .plans.tables import stash
from .scanners import capabilities, contracts, deadcode, duplicates, hardcoded, prose, regions
from .sources import files, git, locks, pyregions, pysource, records, tex

SCHEMA_VERSION = 2
#: Corroborated issues that the report names, by id, and members of each.
CORROBORATED, MEMBERS = 20, 3


@dataclass
class Audit:
    tables: dict[str, DataFrame]
    candidates: DataFrame
    issues: DataFrame
    failures: DataFrame
    locked: DataFrame
    texts: DataFrame
    symbols: DataFrame


#: What of a scanner's row decides its cohort.
GRADED = "max_sim double, twin_match boolean, kind string, priority string"


def run(spark: SparkSession, root: str, package: str = "", public_api: bool = False, settings: dict | None = None, every: bool = False) -> Audit:
    """Each file is read and parsed once for symbols, once for facts and once for regions; all scanners share these tables. Issues are made of candidates whose cohort isn't low, or of all with every."""
    settings = settings or {}
    source = stash(files.scan(spark, root), "files")
    symbols, facts = stash(pysource.symbols(source), "symbols"), stash(pysource.facts(source), "facts")
    areas, bodies = stash(pyregions.regions(source), "regions"), stash(pyregions.bodies(source), "bodies")
    documents, texts = files.texts(files.scan(spark, root, endings=files.DOCUMENTS)), stash(files.texts(source), "texts")
    repeated, helpers, twins = regions.shared(areas), regions.helpers(areas, bodies), regions.twins(bodies)
    of_kind = lambda df, kind, twin: df.select("id", "size", "file_count", "priority", "members", F.lit(kind).alias("kind"), F.lit(twin).alias("twin_match"))
    tables = {
        "duplicates": duplicates.duplicates(symbols),
        "forks": duplicates.forks(symbols, facts),
        "regions": of_kind(repeated, "shared_capability", False).unionByName(of_kind(helpers, "helper_not_reused", False)).unionByName(of_kind(twins, "shared_capability", True)),
        "deadcode": deadcode.deadcode(facts, texts, documents, package, public_api),
        "capabilities": capabilities.overlaps(symbols),
        "env_written_not_read": contracts.env_written_not_read(facts),
        "generation_path_without_env": contracts.generation_path_without_env(facts),
        "defensive_param_loosening": contracts.defensive_param_loosening(facts),
        "forwarding_wrappers": contracts.forwarding_wrappers(symbols),
        "same_name": contracts.same_name(symbols, tuple(config.pick(None, settings, "contracts", "sensitive_names", contracts.SENSITIVE_NAMES))),
        "unreferenced": contracts.unreferenced(symbols, facts),
        "cli_without_bootstrap": contracts.cli_without_bootstrap(facts),
        "experiment_as_library": contracts.experiment_as_library(facts),
        "experiment_path_hacks": contracts.experiment_path_hacks(facts),
        "dynamic_module_runtime_coupling": contracts.dynamic_module_runtime_coupling(stash(pysource.couplings(source), "couplings")),
        "hardcoded": hardcoded.hardcoded(texts, config.patterns(settings), config.pick(None, settings, "hardcoded", "all_patterns", False)),
        "style": prose.findings(tex.documents(files.scan(spark, root, endings=(".tex",))), tuple(config.pick(None, settings, "style", "excluded", prose.EXCLUDED))),
    }
    tables = {k: stash(v, k) for k, v in tables.items()}
    named = ("duplicates", "regions", "forks", "deadcode", "capabilities", "hardcoded", "style")
    found = review.candidates(**{k: tables[k] for k in named}, contracts={k: v for k, v in tables.items() if k not in named})
    found = with_evidence_hash(found).withColumn("g", F.from_json("detail", GRADED))
    found = found.select("*", "g.max_sim", "g.twin_match", "g.kind", "g.priority").withColumn("cohort", F.expr(findings.COHORT))
    locked = stash(locks.locked_files(files.scan(spark, root, endings=(".json",)), source), "locked")
    found = stash(lines.evidence_lines(findings.with_locks(found.select(*review.CANDIDATE, "evidence_hash", "cohort"), locked)), "candidates")
    strip = lambda m: F.regexp_replace(F.regexp_replace(m, ":[0-9]+-[0-9]+$", ""), "#[0-9]+$", "")
    clusters = [tables[s].select(F.lit(s).alias("scanner"), F.col("id").alias("target_id"), F.transform("members", strip).alias("symbols")) for s in ("duplicates", "regions")]
    clusters = clusters[0].unionByName(clusters[1])
    if not every:
        clusters = clusters.join(found.where("cohort <> 'low'").select("scanner", "target_id"), ["scanner", "target_id"], "left_semi")
    return Audit(tables, found, findings.fuse(clusters), facts.where("kind = 'failure'").select("path", "value", "line"), locked, texts, symbols)


def report(audit: Audit, root: str, package: str = "") -> dict:
    """The report as a document. It is the findings of one project, which a reviewer reads; they come to the driver a partition at a time."""
    counts = {r.scanner: {"candidates": r.n, "risks": r.risks} for r in audit.candidates.groupBy("scanner").agg(F.count("*").alias("n"), F.count("risk").alias("risks")).collect()}
    told = audit.issues.where("n_channels >= 2").select("issue_id", "channels", "signals", "n_members", F.slice("members", 1, MEMBERS).alias("members"))
    rows = audit.candidates.orderBy(F.col("risk").isNull(), "risk", "scanner", "target_id").toLocalIterator()
    return {
        "schema_version": SCHEMA_VERSION,
        "package": package,
        "provenance": git.provenance(root),
        "scanners": counts,
        "issues": findings.issue_summary(audit.issues).first().asDict(),
        "corroborated": [r.asDict() for r in told.orderBy("issue_id").limit(CORROBORATED).collect()],
        "parse_failures": [r.asDict() for r in audit.failures.orderBy("path").collect()],
        "complete": audit.failures.isEmpty(),
        "candidates": [{"scanner": r.scanner, "target_id": r.target_id, "display": r.display, "risk": r.risk, "cohort": r.cohort, "evidence_hash": r.evidence_hash, "evidence": r.evidence, "locks": [k.asDict() for k in r.locks], "detail": json.loads(r.detail)} for r in rows],
    }


def markdown(document: dict, every: bool = False) -> str:
    """A worksheet; candidates that are no risk and of the low cohort are only counted, unless every one is asked for."""
    out = [f"# Audit of {document['package'] or 'the project'}", "", f"Commit {document['provenance']['head']} ({document['provenance']['status']})."]
    if not document["complete"]:
        out += ["", "## Files that could not be parsed", "", *(f"- {f['path']}: {f['value']}" for f in document["parse_failures"])]
    out += ["", "| scanner | candidates | risks |", "|---|---:|---:|", *(f"| {s} | {c['candidates']} | {c['risks']} |" for s, c in sorted(document["scanners"].items()))]
    i = document["issues"]
    out += ["", f"{i['issues']} issues from {i['signals']} signals, {i['corroborated']} of them corroborated."]
    if named := document["corroborated"]:
        more = lambda n: f" (+{n})" if n > 0 else ""
        out += ["", "| issue | channels | signals | members |", "|---|---|---:|---|", *(f"| `{n['issue_id']}` | {', '.join(n['channels'])} | {n['signals']} | {', '.join(f'`{m}`' for m in n['members'])}{more(n['n_members'] - len(n['members']))} |" for n in named)]
        out += [f"| | | | {i['corroborated'] - len(named)} more |"] if i["corroborated"] > len(named) else []
    for scanner in sorted(document["scanners"]):
        own = [c for c in document["candidates"] or () if c["scanner"] == scanner]
        told = [c for c in own if every or c["risk"] or c["cohort"] != "low"]
        if told:
            said = [(f"- [ ] {c['risk'] or c['cohort']}: {c['display']} (`{c['target_id']}`)", *([f"  - {c['evidence']}"] if c["evidence"] else []), *(f"  - locked: {k['path']} by {', '.join(k['manifests'])}" for k in c["locks"])) for c in told]
            out += ["", f"## {scanner}", "", *(x for pair in said for x in pair)]
        if len(told) < len(own):
            out += ["", f"{len(own) - len(told)} candidates of {scanner} that are no risk and of the low cohort aren't shown."]
    if change := document.get("previous_run"):
        out += ["", "## Changes since the last run", ""]
        if change["reason"]:
            out += [f"The report before can't be compared: {change['reason']} differs."]
        else:
            out += ["| scanner | previous | current | new | gone |", "|---|---:|---:|---:|---:|", *(f"| {c['scanner']} | {c['previous']} | {c['current']} | {c['new']} | {c['gone']} |" for c in change["scanners"])]
            for c in change["scanners"]:
                for label in ("new", "gone"):
                    names = c[f"first_{label}"]
                    more = [f"- and {c[label] - len(names)} more"] if c[label] > len(names) else []
                    out += ["", f"### {label} of {c['scanner']} ({c[label]})", "", *(f"- {n}" for n in names), *more] if names else []
    if gone := document.get("stale_suppressions"):
        where = lambda g: f", now at line {g['moved_to']}" if g.get("moved_to") else ""
        out += ["", "## Suppressions that no longer fit", "", *(f"- {g['scanner']}: {g['target_id']} ({g['reason']}{where(g)})" for g in gone)]
    return "\n".join(out) + "\n"


def write_text(path: str, text: str) -> None:
    """All of it or nothing: to a file beside it first."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.NamedTemporaryFile("w", dir=target.parent, delete=False, encoding="utf-8") as f:
        f.write(text)
    os.replace(f.name, target)


def suppressed(spark: SparkSession, path: str) -> DataFrame:
    """(scanner, target_id) of a JSON registry; a file that isn't there suppresses nothing. It has a list for each scanner, or a list for each channel of
    it; an entry is a target, or an object whose target_id, id or key is one. Of a channel the target is channel/key. Other sections, such as notes, are read over."""
    known = json.loads(Path(path).read_text()) if Path(path).is_file() else {}
    rows = []
    for scanner, own in known.items():
        for channel, entries in own.items() if isinstance(own, dict) else [("", own)] if isinstance(own, list) else []:
            for e in entries:
                target = e if isinstance(e, str) else next((e[k] for k in ("target_id", "id", "key") if e.get(k)), None)
                if target:
                    rows.append((scanner, f"{channel}/{target}" if channel and not target.startswith(f"{channel}/") else target))
    return spark.createDataFrame(rows, "scanner string, target_id string").distinct()


def registered(spark: SparkSession, path: str) -> DataFrame:
    """(section, key, path) of a JSON registry's entries, as lines.entry_places takes them; sections of contracts are contracts/channel."""
    known = json.loads(Path(path).read_text()) if Path(path).is_file() else {}
    rows = []
    for section, own in known.items():
        for name, entries in ((f"{section}/{c}", e) for c, e in own.items()) if isinstance(own, dict) else [(section, own)] if isinstance(own, list) else []:
            rows += [(name, e.get("key"), e.get("path")) for e in entries if isinstance(e, dict)]
    return spark.createDataFrame(rows, "section string, key string, path string")


def previous_run(spark: SparkSession, path: str, document: dict, found: DataFrame) -> dict | None:
    """What changed since the report at path: why it can't be compared (a property's name, else null), and review.changes for each scanner. None if there is no report that can be read."""
    known = records.previous_candidates(spark, path)
    if known is None:
        return None
    before = json.loads(Path(path).read_text(encoding="utf-8"))
    about = lambda d: {k: sorted(d[k]) if k == "scanners" and d.get(k) else d.get(k) for k in ("schema_version", "package", "scanners", "audit_config_hash", "scanner_bundle_hash")}
    reason = review.comparable(about(before), about(document))
    rows = [] if reason else [r.asDict() for r in review.changes(known, found).orderBy("scanner").collect()]  # a row for each scanner
    return {"reason": reason, "scanners": rows}


def stale(registry: DataFrame, found: DataFrame) -> DataFrame:
    """(scanner, target_id) of the registry that no finding has any more."""
    return registry.join(found.select("scanner", "target_id").distinct(), ["scanner", "target_id"], "left_anti")


def exported(verdicts: DataFrame, day: str, owner: str, found: DataFrame) -> dict:
    """The valid verdicts of false positives as sections of a registry, those of contracts by channel; found: candidates, which say where each stands. They are what reviewers have written."""
    out: dict = {}
    for r in review.registry_entries(verdicts, found).orderBy("section", "target_id").toLocalIterator():
        section, _, channel = r.section.partition("/")
        own = out.setdefault(section, {}).setdefault(channel, []) if channel else out.setdefault(section, [])
        own.append({"target_id": r.target_id} | {k: r[k] for k in ("path", "key") if r[k]} | {"reason": r.reason, "date": day, "owner": owner})
    return out


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tracewell.audit")
    p.add_argument("root")
    p.add_argument("--package", default="")
    p.add_argument("--json")
    p.add_argument("--markdown")
    p.add_argument("--suppress")
    p.add_argument("--public-api", action="store_true")
    p.add_argument("--all", action="store_true")
    p.add_argument("--previous", help="a report of an earlier run, to tell what changed since; it may be the file that --json writes")
    p.add_argument("--snippets", help="a folder that gets the code around each candidate, as JSON lines")
    said = p.parse_args(args)
    from .session import session

    spark = session()
    own = Path(said.root).resolve()
    for path in (said.json, said.markdown):
        if path and path != "-" and Path(path).resolve().is_relative_to(own):
            p.error(f"{path} is in the project, which an audit doesn't change")
    settings = config.load(said.root)
    package, public = config.pick(said.package, settings, "audit", "package", ""), config.pick(said.public_api, settings, "audit", "public_api", False)
    done = run(spark, said.root, package, public, settings, said.all)
    registry, gone = config.pick(said.suppress, settings, "audit", "suppress", None), []
    if registry:
        known = stash(suppressed(spark, registry), "registry")
        gone = [r.asDict() | {"reason": "no such finding", "moved_to": None} for r in stale(known, done.candidates).orderBy("scanner", "target_id").collect()]
        places = lines.stale_places(lines.entry_places(registered(spark, registry)), done.texts)
        gone += [{"scanner": r.section, "target_id": r.key, "reason": r.reason, "moved_to": r.moved_to} for r in places.orderBy("section", "key").collect()]
        done.candidates = findings.suppress(done.candidates, known, ["scanner", "target_id"])[0]
    hashes = {"audit_config_hash": config.digest(settings, {"package": package, "public_api": public, "all": said.all}, registry), "scanner_bundle_hash": config.engine_digest()}
    document = report(done, said.root, package) | hashes | {"stale_suppressions": gone}
    if said.previous:
        document["previous_run"] = previous_run(spark, said.previous, document, done.candidates)
    if said.snippets:
        lines.snippets(lines.locations(done.candidates), done.texts, done.symbols.select("path", "qualname", F.col("start_line").alias("line"))).write.mode("overwrite").json(said.snippets)
    if said.json == "-":
        print(json.dumps(document, indent=2, ensure_ascii=False))
        return 0 if document["complete"] else 2
    if said.json:
        write_text(said.json, json.dumps(document, indent=2, ensure_ascii=False) + "\n")
    text = markdown(document, said.all)
    if said.markdown:
        write_text(said.markdown, text)
    else:
        print(text)
    return 0 if document["complete"] else 2


if __name__ == "__main__":
    raise SystemExit(main())
