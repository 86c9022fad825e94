"""Python source files as typed rows: symbols and facts, each file parsed once for each.

A file that can't be parsed gives one row of facts of kind `failure` and no symbols, so that nothing is dropped in silence.
"""

from __future__ import annotations

import ast
import copy
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

SYMBOLS = """path string, position int, name string, qualname string, enclosing string, start_line int, end_line int, n_lines int, ordinal int, stub boolean,
 arg_count int, node_count int, top_signature array<string>, normalized string, tokens array<string>, sig_shape string, signature string, doc string,
 reuse_tokens array<string>, calls array<string>, literals array<string>, returns_value boolean, return_kinds array<string>, forwards_to string, passes_varargs boolean, passes_kwargs boolean"""
COUPLINGS = """path string, loads array<struct<line:int,kind:string,binding:string,source:string>>, module_bindings array<string>,
 rebindings array<struct<line:int,target:string,attribute:string>>"""
FACTS = "path string, kind string, value string, detail string, line int"
#: Fixed values.
CODE = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|==|!=|<=|>=|:=|->|\*\*|//|<<|>>|[^\s]")
REUSE = re.compile(r"[A-Za-z_]\w*|\d+|[^\sA-Za-z_0-9]")
REUSE_TOKENS = 200
BUILTIN_CALLS = frozenset("abs all any bool dict enumerate float int isinstance len list map max min print range repr reversed round set sorted str sum super tuple type zip".split())
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def decoded(content: bytes) -> str:
    return bytes(content).decode("utf-8-sig", "replace")


def definitions(tree: ast.AST) -> Iterator[tuple[ast.AST, list[str], str]]:
    """Every function, in the order of the text: the node, the names around it, and what directly holds it (module, class or other)."""
    waiting = [(child, [], "module") for child in reversed(list(ast.iter_child_nodes(tree)))]
    while waiting:
        node, names, holder = waiting.pop()
        if isinstance(node, FUNCTIONS):
            yield node, names, holder
            inside, names = "other", [*names, node.name]
        elif isinstance(node, ast.ClassDef):
            inside, names = "class" if holder == "module" else "other", [*names, node.name]
        else:
            inside = holder if isinstance(node, (ast.If, ast.Try, ast.With)) else "other"
        waiting += [(child, names, inside) for child in reversed(list(ast.iter_child_nodes(node)))]


def _stand_in(value: object) -> object:
    for kinds, other in (((bool, type(None)), value), ((str,), "_str"), ((bytes,), b"_bytes"), ((int, float, complex), 0)):
        if isinstance(value, kinds):
            return other
    return None


def anonymous(node: object, reuse: bool = False) -> object:
    """A copy with names, arguments and literals made alike; called attributes and keywords stay, unless reuse asks for these too."""
    if isinstance(node, list):
        return [anonymous(x, reuse) for x in node]
    if not isinstance(node, ast.AST):
        return node
    if isinstance(node, ast.JoinedStr):
        return ast.Constant("_fstr")
    if isinstance(node, ast.Constant):
        return ast.Constant(_stand_in(node.value))
    made = type(node)(**{f: anonymous(v, reuse) for f, v in ast.iter_fields(node)})
    if isinstance(made, ast.Name):
        made.id = "_name"
    elif isinstance(made, ast.arg):
        made.arg = "_arg"
    elif reuse and isinstance(made, ast.Attribute):
        made.attr = "_attr"
    elif reuse and isinstance(made, ast.keyword) and made.arg:
        made.arg = "_kw"
    return made


def _said(statement: ast.stmt) -> str | None:
    inner = getattr(statement, "value", None)
    return inner.value if isinstance(statement, ast.Expr) and isinstance(inner, ast.Constant) and isinstance(inner.value, str) else None


def _bare(node: ast.AST) -> ast.AST:
    """A copy without docstring, under one name for all."""
    bare = copy.copy(node)
    bare.name = "_function"
    bare.body = node.body[1:] if node.body and _said(node.body[0]) is not None else node.body
    return bare


def _shape(args: ast.arguments) -> str:
    plain = len(args.posonlyargs) + len(args.args)
    said = ["p=" if i >= plain - len(args.defaults) else "p" for i in range(plain)]
    said += ["*p"] * bool(args.vararg)
    said += ["k" if d is None else "k=" for d in args.kw_defaults]
    return "(" + ", ".join(said + ["**p"] * bool(args.kwarg)) + ")"


def dotted(node: ast.AST) -> str | None:
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    return ".".join(reversed([*names, node.id])) if isinstance(node, ast.Name) else None


def _own(body: list[ast.stmt]) -> Iterator[ast.AST]:
    """The nodes of a body without those of functions and classes inside it."""
    waiting = list(body)
    while waiting:
        node = waiting.pop()
        if not isinstance(node, (*FUNCTIONS, ast.ClassDef, ast.Lambda)):
            yield node
            waiting += ast.iter_child_nodes(node)


def _return_kinds(node: ast.AST) -> list[str]:
    kinds = {"implicit-None" if x.value is None else type(x.value).__name__ for x in _own(node.body) if isinstance(x, ast.Return)}
    return sorted(kinds) or ["implicit-None"]


def _forward(bare: ast.AST) -> tuple[str | None, bool, bool]:
    """The call whose value is all that the function returns, and whether it is given * or **."""
    match bare.body:
        case [ast.Return(value=ast.Call(func=target, args=args, keywords=named))]:
            return dotted(target) or ast.unparse(target), any(isinstance(a, ast.Starred) for a in args), any(k.arg is None for k in named)
    return None, False, False


def symbols_of(path: str, source: str) -> list[tuple]:
    rows, seen = [], {}
    for position, (node, names, holder) in enumerate(definitions(ast.parse(source))):
        bare = _bare(node)
        stub = len(bare.body) == 1 and isinstance(bare.body[0], ast.Expr) and isinstance(bare.body[0].value, ast.Constant) and bare.body[0].value.value is Ellipsis
        qualname = ".".join([*names, node.name])
        ordinal = seen.get(qualname, 0)
        seen[qualname] = ordinal + (not stub)
        body = bare if bare.body else type(bare)(**{**dict(ast.iter_fields(bare)), "body": [ast.Pass()]})
        plain = " ".join(ast.unparse(ast.fix_missing_locations(anonymous(bare))).split())
        alike = ast.unparse(ast.fix_missing_locations(anonymous(body, reuse=True)))
        calls = {x.func.id if isinstance(x.func, ast.Name) else x.func.attr for x in ast.walk(node) if isinstance(x, ast.Call) and isinstance(x.func, (ast.Name, ast.Attribute)) and not (isinstance(x.func, ast.Name) and x.func.id in BUILTIN_CALLS)}
        literals = {x.value for s in bare.body for x in ast.walk(s) if isinstance(x, ast.Constant) and isinstance(x.value, str)}
        returns = any(isinstance(x, ast.Return) and x.value is not None for x in ast.walk(node))
        doc = (ast.get_docstring(node) or "").strip().split("\n")[0]
        args = node.args
        rows.append((
            path, position, node.name, qualname, holder, node.lineno, node.end_lineno, node.end_lineno - node.lineno + 1, ordinal, stub,
            len(args.posonlyargs) + len(args.args) + len(args.kwonlyargs), sum(1 for _ in ast.walk(bare)), [type(x).__name__ for x in bare.body[:3]],
            plain, CODE.findall(plain), _shape(args), f"({ast.unparse(args)})", doc, REUSE.findall(alike)[:REUSE_TOKENS], sorted(calls), sorted(literals), returns, _return_kinds(node), *_forward(bare),
        ))
    return rows


def _strings(node: ast.AST | None) -> list[str]:
    return [x.value for x in ast.walk(node) if isinstance(x, ast.Constant) and isinstance(x.value, str)] if node is not None else []


def _argument(call: ast.Call, position: int, *names: str) -> ast.AST | None:
    if position < len(call.args):
        return call.args[position]
    return next((k.value for n in names for k in call.keywords if k.arg == n), None)


def _imported(path: str, node: ast.AST) -> list[str]:
    if isinstance(node, ast.Import):
        return [a.name for a in node.names]
    around = path.removesuffix(".py").split("/")[:-1]
    base = around[: max(0, len(around) - node.level + 1)] if node.level else []
    base = ".".join(base + (node.module.split(".") if node.module else []))
    return [base] * bool(base) + [".".join(x for x in (base, a.name) if x) for a in node.names if a.name != "*"]


def _environment(node: ast.AST) -> tuple[str, str] | None:
    """Whether an expression reads or writes a named variable of the environment."""
    if isinstance(node, ast.Subscript) and dotted(node.value) == "os.environ" and isinstance(node.slice, ast.Constant):
        return ("env_write" if isinstance(node.ctx, ast.Store) else "env_read"), str(node.slice.value)
    if isinstance(node, ast.Call) and dotted(node.func) in ("os.getenv", "os.environ.get", "os.environ.pop", "os.environ.setdefault", "os.putenv") and node.args and isinstance(node.args[0], ast.Constant):
        return ("env_write" if dotted(node.func) in ("os.environ.setdefault", "os.putenv") else "env_read"), str(node.args[0].value)
    return None


def _loads_file(call: ast.Call) -> bool:
    return (dotted(call.func) or "").rsplit(".", 1)[-1] in ("spec_from_file_location", "SourceFileLoader")


def _through_wrappers(tree: ast.AST) -> Iterator[tuple[str, int]]:
    """Literals handed to functions that pass a parameter on as the name or path of a file to load; the path's is preferred."""
    slots: dict[str, set[int]] = {}
    for f in ast.walk(tree):
        if isinstance(f, ast.FunctionDef):
            own = {a.arg for a in f.args.args}
            for call in (x for x in ast.walk(f) if isinstance(x, ast.Call) and _loads_file(x)):
                given = (_argument(call, 0, "fullname", "name"), _argument(call, 1, "location", "path"))
                slots.setdefault(f.name, set()).update(i for i, a in enumerate(given) if isinstance(a, ast.Name) and a.id in own)
    for call in ast.walk(tree):
        if isinstance(call, ast.Call) and isinstance(call.func, ast.Name):
            said = [_strings(_argument(call, i)) for i in sorted(slots.get(call.func.id, ()), reverse=True)]
            if first := next((s for s in said if s), None):
                yield first[0], call.lineno


def facts_of(path: str, source: str) -> list[tuple]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as e:
        return [(path, "failure", str(getattr(e, "msg", e)), None, getattr(e, "lineno", None))]
    rows = [(path, "file", None, None, source.count("\n") + 1)]
    add = lambda kind, value, node, detail=None: rows.append((path, kind, value, detail, getattr(node, "lineno", None)))
    for node in ast.walk(tree):
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            for name in _imported(path, node):
                add("import", name, node)
        elif isinstance(node, ast.If) and isinstance(node.test, ast.Compare) and dotted(node.test.left) == "__name__" and any(isinstance(c, ast.Constant) and c.value == "__main__" for c in node.test.comparators):
            add("main_guard", None, node)
        elif isinstance(node, (ast.Name, ast.Attribute)) and isinstance(node.ctx, ast.Load):
            add("load", node.id if isinstance(node, ast.Name) else node.attr, node)
        if isinstance(node, ast.Call):
            name = dotted(node.func) or ""
            if _loads_file(node):
                said = _strings(_argument(node, 1, "location", "path")) or _strings(_argument(node, 0, "fullname", "name"))
                if said:
                    add("dynamic", said[0], node, "importlib_file")
            elif name.rsplit(".", 1)[-1] == "import_module" or name == "__import__":
                said = _strings(_argument(node, 0, "name"))
                if said:
                    add("dynamic", said[0], node, "dunder_import" if name == "__import__" else "importlib_module")
            elif name in ("sys.path.insert", "sys.path.append"):
                for s in _strings(node):
                    add("sys_path", s, node)
            for k in node.keywords:
                if k.arg == "strict" and isinstance(k.value, ast.Constant) and k.value.value is False and name.rsplit(".", 1)[-1] == "load_state_dict":
                    add("strict_false", name, node)
                if k.arg == "weights_only" and isinstance(k.value, ast.Constant) and k.value.value is False and name.endswith("torch.load"):
                    add("weights_only_false", name, node)
        if found := _environment(node):
            add(found[0], found[1], node)
        if isinstance(node, ast.Constant) and isinstance(node.value, str) and "generation_" in node.value:
            add("generation", node.value, node)
    for value, line in _through_wrappers(tree):
        rows.append((path, "dynamic", value, "importlib_file", line))
    return rows


#: Calls that load a module while a program runs: what is loaded, and which argument says it. What gives a module to a name.
LOADERS = {"spec_from_file_location": ("file", 1), "import_module": ("import", 0)}
MAKERS = ("module_from_spec", "import_module")
SAID = 160


def _root(e: ast.AST) -> str | None:
    return _root(e.value) if isinstance(e, (ast.Attribute, ast.Subscript)) else getattr(e, "id", None)


def couplings_of(path: str, source: str) -> list[tuple]:
    """One row if the file loads modules by a call whose value is given to something: the loads, the names that hold modules, and the
    attributes that are set on these names, or on the variable of a loop over them."""
    nodes = list(ast.walk(ast.parse(source)))
    given = [(n, n.targets if isinstance(n, ast.Assign) else [n.target]) for n in nodes if isinstance(n, (ast.Assign, ast.AnnAssign, ast.AugAssign))]
    called = [(n, [t.id for t in targets if isinstance(t, ast.Name)], n.value, dotted(n.value.func) or "") for n, targets in given if isinstance(n.value, ast.Call) and not isinstance(n, ast.AugAssign)]
    ends = lambda name, among: next((x for x in among if name.endswith(x)), None)
    loads = []
    for n, names, call, name in called:
        if loader := ends(name, LOADERS):
            kind, place = LOADERS[loader]
            said = ast.unparse(call.args[place]) if len(call.args) > place else "<dynamic>"
            loads.append({"line": n.lineno, "kind": kind, "binding": names[0] if names else None, "source": said[:SAID]})
    if not loads:
        return []
    modules = {x for _, names, _, name in called if ends(name, MAKERS) for x in names}
    loops = {n.target.id for n in nodes if isinstance(n, (ast.For, ast.AsyncFor)) and isinstance(n.target, ast.Name) and any(_root(x) in modules for x in ast.walk(n.iter))}
    set_on = [{"line": n.lineno, "target": ast.unparse(t)[:SAID], "attribute": t.attr} for n, targets in given for t in targets if isinstance(t, ast.Attribute) and _root(t) in modules | loops]
    return [(path, loads, sorted(modules), set_on)]


def _rows(files: DataFrame, of, schema: str, quiet: bool) -> DataFrame:
    columns = StructType.fromDDL(schema).names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for path, content in zip(b["path"], b["content"], strict=True):
                try:
                    rows += of(path, decoded(content))
                except (SyntaxError, ValueError, RecursionError):
                    if not quiet:
                        raise
            yield pd.DataFrame(rows, columns=columns)

    return files.select("path", "content").mapInPandas(run, schema)


def symbols(files: DataFrame) -> DataFrame:
    """A row for each function of every file that can be parsed; facts has the others."""
    return _rows(files, symbols_of, SYMBOLS, quiet=True)


def couplings(files: DataFrame) -> DataFrame:
    """A row for each file that loads modules while it runs."""
    return _rows(files, couplings_of, COUPLINGS, quiet=True)


def facts(files: DataFrame) -> DataFrame:
    return _rows(files, facts_of, FACTS, quiet=False)
