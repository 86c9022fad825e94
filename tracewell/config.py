"""Settings of a project: tracewell.toml at its root. What the command line says comes first, then the file, then the default."""

from __future__ import annotations

import hashlib
import json
import tomllib
from pathlib import Path
from typing import Any

from .scanners.hardcoded import PATTERNS, Pattern

FILE = "tracewell.toml"
#: Sections, their keys and what each must be.
KEYS: dict[str, dict[str, type]] = {
    "audit": {"package": str, "public_api": bool, "suppress": str},
    "hardcoded": {"patterns": list, "all_patterns": bool},
    "contracts": {"sensitive_names": list},
    "style": {"excluded": list},
}


def load(root: str) -> dict[str, dict[str, Any]]:
    """The file's sections; none if there is no file. A section or key that isn't known, or of another type, is an error."""
    path = Path(root, FILE)
    if not path.is_file():
        return {}
    read = tomllib.loads(path.read_text(encoding="utf-8"))
    for section, own in read.items():
        if section not in KEYS or not isinstance(own, dict):
            raise ValueError(f"{FILE}: no section {section}")
        for key, value in own.items():
            kind = KEYS[section].get(key)
            if kind is None or not isinstance(value, kind):
                raise ValueError(f"{FILE}: {section}.{key} is " + ("not known" if kind is None else f"no {kind.__name__}"))
            if kind is list and key != "patterns" and not all(isinstance(x, str) for x in value):
                raise ValueError(f"{FILE}: {section}.{key} is no list of texts")
    patterns(read)
    return read


def pick(said: Any, settings: dict[str, dict[str, Any]], section: str, key: str, default: Any) -> Any:
    return said if said not in (None, False, "") else settings.get(section, {}).get(key, default)


def digest(settings: dict[str, dict[str, Any]], said: dict[str, Any], registry: str | None = None) -> str:
    """Of what changes findings: the settings but for where the registry lies, what the command line said, and the registry's content."""
    own = {s: {k: v for k, v in keys.items() if (s, k) != ("audit", "suppress")} for s, keys in settings.items()}
    held = Path(registry).read_text(encoding="utf-8") if registry and Path(registry).is_file() else None
    return hashlib.sha256(json.dumps([own, said, held], sort_keys=True).encode()).hexdigest()


def engine_digest() -> str:
    """Of the engine's own files, by name."""
    root = Path(__file__).parent
    each = sorted((str(p.relative_to(root)), hashlib.sha256(p.read_bytes()).hexdigest()) for p in root.rglob("*.py") if p.relative_to(root).parts[0] != "llm")
    return hashlib.sha256("\n".join(f"{n} {h}" for n, h in each).encode()).hexdigest()


def patterns(settings: dict[str, dict[str, Any]]) -> tuple[Pattern, ...]:
    """The patterns of the settings, in place of the default ones."""
    own = settings.get("hardcoded", {}).get("patterns")
    if own is None:
        return PATTERNS
    try:
        return tuple(Pattern(p["name"], p["regex"], p.get("severity", "medium"), tuple(p.get("exclude_paths", ()))) for p in own)
    except (KeyError, TypeError) as e:
        raise ValueError(f"{FILE}: a pattern needs name and regex") from e
