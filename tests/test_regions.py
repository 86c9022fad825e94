"""Region scanners over modules written for each rule."""

import pytest

from tracewell.scanners import regions as scan
from tracewell.sources import files, pyregions

SHARED = '''
def {name}(path, model, rows):
    first = model.read(path)

    table = model.load(path)
    for row in rows:
        if row.kind == "a":
            table.append(row.value)
        else:
            table.extend(row.values)
    model.save(table, path)
    model.close()
    model.log(table)
    model.flush()
'''
HELPER = '''
def check(value, low, high):
    if value is None:
        raise ValueError("none")
    if not isinstance(value, int):
        raise TypeError("kind")
    if value < low:
        raise ValueError("low")
    return value
'''
COPY = '''
def run(client, value, low, high):
    session = client.open()
    if value is None:
        raise ValueError("none")
    if not isinstance(value, int):
        raise TypeError("kind")
    if value < low:
        raise ValueError("low")
    spare = low
    extra = high
    session.send(value)
    return session.close()
'''
TWIN = '''
def {name}(client, items):
    out = []
    for item in items:
        out.append(client.fetch(item.key, retries={n}))
    client.commit(out)
    client.close()
    return out
'''
RISKY = '''
def {name}(tables, a, b):
    x = tables["S00"][a, a] + tables["S01"][a, b] - tables["S10"][b, a]
    return x
'''


@pytest.fixture(scope="module")
def project(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("regions")
    own = {
        "lib/check.py": HELPER, "experiments/run.py": COPY,
        "experiments/p.py": SHARED.format(name="persist"), "experiments/q.py": SHARED.format(name="keep").replace("model.flush()", "model.flush(True)"),
        "experiments/t1.py": TWIN.format(name="left", n=2), "experiments/t2.py": TWIN.format(name="right", n=3),
        "experiments/r1.py": RISKY.format(name="scores"), "experiments/r2.py": RISKY.format(name="entropy"),
    }
    for path, text in own.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    found = files.scan(spark, str(root))
    return pyregions.regions(found).cache(), pyregions.bodies(found).cache()


def test_shared_and_short(project):
    rows = scan.shared(project[0]).collect()
    by = {tuple(sorted({m.rsplit(":", 1)[0] for m in r.members})): r for r in rows}
    pair = by["experiments/p.py:persist", "experiments/q.py:keep"]
    assert pair.file_count == 2 and pair.priority == "medium" and pair.max_sim >= 0.9 and "load" in pair.hints
    risky = by["experiments/r1.py:scores", "experiments/r2.py:entropy"]
    assert risky.priority == "high" and risky.signals == ["asymmetric_indexing"]


def test_helper(project):
    (one,) = [r for r in scan.helpers(*project).collect() if r.canonical == "lib/check.py:check"]
    assert one.members[0].startswith("experiments/run.py:run:") and one.coverage >= 0.85 and one.priority == "high" and one.file_count == 2


def test_twins(project):
    found = {tuple(r.members): (r.priority, r.max_sim) for r in scan.twins(project[1]).collect()}
    assert found == {("experiments/t1.py:left", "experiments/t2.py:right"): ("high", 1.0), ("experiments/p.py:persist", "experiments/q.py:keep"): ("high", 0.9863)}


def test_signatures():
    import ast

    a, b = (ast.parse(s).body for s in ("x = t['S00'][i, i] + t['S01'][i, j]", "y = q['S01'][m, n] - q['S00'][k, k]"))
    assert pyregions.short_signature(a) == pyregions.short_signature(b) is not None
    assert pyregions.short_signature(ast.parse("x = t[i, i]").body) is None
    assert pyregions.semantic_risk(ast.parse("f(x, dtype=1, device=2)\ng(strict=False)\nz = 1e-12 + 1e-12").body) == (0.9, ["contract_kwargs", "repeated_constants"])
    assert pyregions._outer([(1, 9), (2, 3), (9, 12), (4, 9)]) == {(1, 9), (9, 12)}
