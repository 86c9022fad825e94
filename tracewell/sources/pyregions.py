"""Regions of functions as rows: stretches of statements that could be a function of their own, and the functions they could copy.

A function's body is cut in five ways (suites, runs of plain statements, paragraphs, runs without method calls, risky statements). Cuts that no larger
one contains can be shared or helper regions; contained ones only helper or short, risky ones.
"""

from __future__ import annotations

import ast
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .pysource import CODE, FUNCTIONS, _said, anonymous, decoded, definitions

REGIONS = """path string, parent string, start_line int, end_line int, n_statements int, n_lines int, tokens array<string>, calls array<string>, control_shape string,
 inputs array<string>, outputs array<string>, used_after array<string>, effects array<string>, exits array<string>, extractability double, risk double, signals array<string>,
 channel string, parent_tokens array<string>, short_signature string"""
BODIES = "path string, qualname string, name string, start_line int, n_statements int, tokens array<string>, calls array<string>, covered boolean, api_calls boolean"
#: Limits, and what binds a call to a contract.
STATEMENTS, LINES, INPUTS, OUTPUTS, EXTRACTABLE = (5, 40), 80, 8, 4, 0.5
LEAST_TOKENS = {"shared": 30, "helper": 25, "short_risky": 18}
CONTRACT = {"dtype", "device", "strict", "weights_only"}
COMMON = {"main", "parse_args", "require", "close", "count"}
CONTROL = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith)
LEAVING = (ast.Return, ast.Raise, ast.Break, ast.Continue)
INSIDE = (*FUNCTIONS, ast.ClassDef)
Block = list[ast.stmt]


def _walk(block: Block) -> Iterator[ast.AST]:
    for s in block:
        yield from ast.walk(s)


def _in_order(block: list[ast.AST]) -> Iterator[ast.AST]:
    """Nodes before what they hold, from left to right, without those of functions and classes inside."""
    waiting = list(reversed(block))
    while waiting:
        node = waiting.pop()
        if not isinstance(node, INSIDE):
            yield node
            waiting += reversed(list(ast.iter_child_nodes(node)))


def _tokens(block: Block, alike: bool = True) -> list[str]:
    tree = ast.Module(body=anonymous(block) if alike else block, type_ignores=[])
    text = ast.unparse(ast.fix_missing_locations(tree))
    return CODE.findall(" ".join(text.split()) if alike else text)


def _span(block: Block) -> tuple[int, int]:
    return block[0].lineno, block[-1].end_lineno or block[-1].lineno


def _calls_method(block: Block) -> bool:
    return any(isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) for n in _walk(block))


# -- the ways to cut --------------------------------------------------------------


def _suites(body: Block) -> Iterator[Block]:
    for s in body:
        if isinstance(s, CONTROL):
            inner = [s.body, getattr(s, "orelse", [])]
            if isinstance(s, ast.Try):
                inner += [h.body for h in s.handlers] + [s.finalbody]
            for block in inner:
                yield block
                yield from _suites(block)


def _runs(body: Block, ends, takes) -> Iterator[Block]:
    """Runs of statements: one ends before a statement for which ends(last, s) holds; statements that takes() refuses belong to none."""
    run: Block = []
    for s in body:
        if run and ends(run[-1], s):
            yield run
            run = []
        if takes(s):
            run.append(s)
    yield run


def _risky(body: list[ast.AST]) -> Iterator[Block]:
    for s in body:
        if isinstance(s, ast.stmt) and not isinstance(s, INSIDE):
            if semantic_risk([s])[0] > 0:
                yield [s]
            yield from _risky(list(ast.iter_child_nodes(s)))


def _cuts(node: ast.AST, body: Block) -> dict[tuple[int, int], Block]:
    plain = lambda s: not isinstance(s, (*CONTROL, *LEAVING))
    quiet = lambda s: not _calls_method([s])
    ways = (
        _suites(node.body),
        _runs(node.body, lambda _, s: not plain(s), plain),
        _runs(node.body, lambda last, s: s.lineno - (last.end_lineno or last.lineno) > 1, lambda s: True),
        _runs(body, lambda _, s: not quiet(s), quiet),
        _risky(node.body),
    )
    out: dict[tuple[int, int], Block] = {}
    for way in ways:
        for block in way:
            if block:
                out.setdefault(_span(block), block)
    return out


def _outer(spans: list[tuple[int, int]]) -> set[tuple[int, int]]:
    kept, reach = set(), -1
    for start, end in sorted(spans, key=lambda x: (x[0], -x[1])):
        if end > reach:
            kept.add((start, end))
            reach = end
    return kept


# -- what a block is like -----------------------------------------------------------


def _part(e: ast.expr) -> object:
    match e:
        case ast.Name(id=held) | ast.Constant(value=held):
            return held
    return None


def _patterns(block: Block) -> list[tuple[ast.Subscript, tuple]]:
    found = [(n, tuple(map(_part, n.slice.elts))) for n in _walk(block) if isinstance(n, ast.Subscript) and isinstance(n.slice, ast.Tuple)]
    return [(n, p) for n, p in found if len(p) >= 2]


def _repeats(parts: tuple) -> tuple[int, bool]:
    names = [p for p in parts if isinstance(p, str)]
    return len(names), len(set(names)) < len(names)


def semantic_risk(block: Block) -> tuple[float, list[str]]:
    """What makes a short block dense: asymmetric indexing, calls bound to a contract (each counts), repeated constants."""
    patterns = _patterns(block)
    by_name: dict[str, set] = {}
    for n, p in patterns:
        if isinstance(n.value, ast.Name):
            by_name.setdefault(n.value.id, set()).add(p)
    asymmetric = any(_repeats(p)[0] >= 2 and _repeats(p)[1] for _, p in patterns) or any(len(x) > 1 for x in by_name.values())
    bound = sum(isinstance(n, ast.Call) and any(k.arg in CONTRACT for k in n.keywords) for n in _walk(block))
    numbers = Counter(n.value for n in _walk(block) if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool) and n.value not in (0, 1))
    again = any(c >= 2 for c in numbers.values())
    signals = [s for s, x in (("asymmetric_indexing", asymmetric), ("contract_kwargs", bound), ("repeated_constants", again)) if x]
    return round(0.45 * asymmetric + 0.35 * bound + 0.2 * again, 2), signals


def short_signature(block: Block) -> str | None:
    """The multiset of a block's subscript patterns as text, without names; none if there are fewer than two."""
    seen: Counter = Counter()
    for n, p in _patterns(block):
        names, again = _repeats(p)
        inner = n.value.slice if isinstance(n.value, ast.Subscript) else None
        seen[repr((inner.value if isinstance(inner, ast.Constant) else None, ("diag" if again else "off") if names >= 2 else p))] += 1
    return "; ".join(f"{k} x{c}" for k, c in sorted(seen.items())) if sum(seen.values()) >= 2 else None


def _events(block: Block) -> list[tuple[str, str | None, str | None, bool]]:
    """What a block does, in order: (Store or Load, name), and (Call, the name at the root if there is one, what is called, whether it is a method)."""
    out = []
    for n in _in_order(block):
        if isinstance(n, ast.Name):
            out.append((type(n.ctx).__name__, n.id, None, False))
        elif isinstance(n, ast.Call):
            spelled = [getattr(x, "attr", None) or getattr(x, "id", None) for x in _chain(n.func)]
            out.append(("Call", getattr(_chain(n.func)[-1], "id", None), spelled[0], isinstance(n.func, ast.Attribute)))
    return out


def _chain(e: ast.expr) -> list[ast.expr]:
    """a.b.c as c, b and a."""
    return [e, *_chain(e.value)] if isinstance(e, ast.Attribute) else [e]


def _first(events: list, kind: str) -> dict[str, int]:
    return {name: i for i, (what, name, *_) in reversed(list(enumerate(events))) if what == kind}


def _names(events: list, local: set[str]) -> tuple[list[str], list[str]]:
    """What a block reads of the function's names without setting it, and what it reads before it sets it, as it sets them."""
    read, stored = _first(events, "Load"), _first(events, "Store")
    outputs = [x for x, i in sorted(stored.items(), key=lambda x: x[1]) if x in read and min(read[x], i) == read[x]]
    return sorted(read.keys() & local - stored.keys()), outputs


def _effects(events: list, local: set[str]) -> list[str]:
    """What is called by names that aren't the function's, and methods of names that the block hasn't set by then."""
    calls, stored = [(i, *x[1:]) for i, x in enumerate(events) if x[0] == "Call" and x[1]], _first(events, "Store")
    foreign = {called for _, root, called, _ in calls if root not in local}
    owned = {f"method_on_input:{called}" for i, root, called, method in calls if method and root in local and stored.get(root, i) >= i}
    return sorted(foreign | owned)


def _called(events: list) -> list[str]:
    return sorted({called for what, _, called, _ in events if what == "Call" and called})


def _shape(block: Block) -> str:
    kinds = [type(n).__name__ for n in _walk(block)]
    return "".join(f"{k}{sum(x.startswith(k) for x in kinds)}" for k in ("If", "For", "While", "Try", "With"))


def _locals(node: ast.AST) -> set[str]:
    args = node.args
    every = [*args.posonlyargs, *args.args, *args.kwonlyargs, *filter(None, (args.vararg, args.kwarg))]
    held = list(ast.iter_child_nodes(node))
    return {a.arg for a in every} | {n.id for n in _in_order(held) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store)}


EXITS = {ast.Break: "break", ast.Continue: "continue", ast.Return: "return", ast.Yield: "yield", ast.YieldFrom: "yield", ast.Await: "await"}


def _region(block: Block, outer: bool, local: set[str], later: set[str]) -> tuple | None:
    (start, end), n = _span(block), len(block)
    risk, signals = semantic_risk(block)
    low, high = STATEMENTS
    channel = ("shared" if _calls_method(block) else "helper") if low <= n <= high else "short_risky" if risk > 0 and n < low else None
    if channel is None or end - start >= LINES or (channel == "shared" and not outer):
        return None
    inside = list(_in_order(block))
    if any(isinstance(x, (ast.Yield, ast.YieldFrom, ast.Await)) for x in inside):
        return None
    events = _events(block)
    inputs, outputs = _names(events, local)
    leaves = sum(isinstance(x, (ast.Break, ast.Continue)) for x in inside)
    tries = sum(isinstance(x, ast.Try) for x in _walk(block))
    score = round(min(1.0, max(0.0, 1.0 - 0.08 * len(inputs) - 0.1 * len(outputs) - 0.06 * leaves - 0.04 * tries)), 2)
    if channel != "short_risky" and (len(inputs) > INPUTS or len(outputs) > OUTPUTS or score < EXTRACTABLE):
        return None
    tokens = _tokens(block)
    signature = short_signature(block) if channel == "short_risky" else None
    if len(tokens) < LEAST_TOKENS[channel] or channel == "short_risky" and signature is None:
        return None
    stored = {x.id for x in _walk(block) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Store)}
    exits = sorted({EXITS[type(x)] for x in _walk(block) if type(x) in EXITS})
    return (start, end, n, end - start + 1, tokens, _called(events), _shape(block), inputs, outputs, sorted(stored & later), _effects(events, local), exits, score, risk, signals, channel, signature)


def of_file(path: str, source: str) -> tuple[list[tuple], list[tuple]]:
    """The regions and the bodies of one file."""
    regions, bodies, whole = [], [], {}
    for node, names, _ in definitions(ast.parse(source)):
        parent = ".".join([*names, node.name])
        body = node.body[1:] if _said(node.body[0]) is not None else node.body
        if not body:
            continue
        local, cuts, own = _locals(node), _cuts(node, body), _tokens(body, alike=False)
        outer, whole[parent] = _outer(list(cuts)), _span(body)
        for span, block in sorted(cuts.items(), key=lambda x: (x[0] not in outer, x[0])):
            later = {x.id for s in body if s.lineno > span[1] for x in ast.walk(s) if isinstance(x, ast.Name) and isinstance(x.ctx, ast.Load)}
            if row := _region(block, span in outer, local, later):
                regions.append((path, parent, *row[:-1], own, row[-1]))
        if 3 <= len(body) <= 60 and node.name not in COMMON:
            tokens = _tokens(body)
            if len(tokens) >= 25:
                bodies.append((path, parent, node.name, node.lineno, len(body), tokens, _called(_events(body)), _calls_method(body)))
    covered = {r[1] for r in regions if whole.get(r[1]) == (r[2], r[3])}
    return regions, [(*b[:7], b[1] in covered, b[7]) for b in bodies]


def _rows(files: DataFrame, which: int, schema: str) -> DataFrame:
    columns = [c.split()[0] for c in schema.replace("\n", " ").split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += of_file(path, decoded(content))[which]
                except (SyntaxError, ValueError, RecursionError):
                    continue  # facts has a row for it
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def regions(files: DataFrame) -> DataFrame:
    return _rows(files, 0, REGIONS)


def bodies(files: DataFrame) -> DataFrame:
    return _rows(files, 1, BODIES)
