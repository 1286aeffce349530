"""Structural patterns, workspaces, text lines, impact and components against brute force."""

import os
import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest

from loomgraph.operators import graph, render, structural
from loomgraph.plans import workspace
from loomgraph.schemas import Index
from loomgraph.sources import brace_front, patterns, python_front

CODE = "def outer(a):\n    def inner():\n        return go(a)\n    return x.run(1, inner())\nclass K:\n    def m(self):\n        go(2)\n"


def found(pattern, source=CODE, lang="python"):
    facts = python_front.parse(source) if lang == "python" else brace_front.parse(lang, source)
    return [[(c, n.text.split("\n")[0]) for c, n in m] for m in patterns.matches(patterns.compiled(lang, pattern), patterns.tree(lang, source, facts))]


def test_patterns():
    assert found("(function_definition name: (identifier) @n)") == [[("n", "outer")], [("n", "inner")], [("n", "m")]]
    assert found("(class_definition (function_definition name: (_) @m)) @c") == [[("c", "class K:"), ("m", "m")]]
    assert found('(call function: (identifier) @f (#match? @f "^g"))') == [[("f", "go")], [("f", "go")]]
    assert found("(call function: (member_expression object: (identifier) @o property: (identifier) @p)) @call") == [[("call", "x.run(1, inner())"), ("o", "x"), ("p", "run")]]
    assert found('[(class_definition) (call function: (identifier) @f (#not-eq? @f "go"))] @any') == [[("any", "inner()"), ("f", "inner")], [("any", "class K:")]]
    assert found("(method_definition name: (identifier) @n)", "class A { go() { b(); } }", "typescript") == [[("n", "go")]]
    for bad in ("", "(call", "(nonsense) @x", "(call)", "(call) @x )", '(call (#near? @x "a")) @x'):
        with pytest.raises(patterns.BadPattern):
            patterns.compiled("python", bad)


def test_structural_search(spark):
    files = spark.createDataFrame([("b/two.py", "python", CODE), ("a/one.py", "python", "go(1)\n"), ("c.ts", "typescript", "go(1)"), ("a/bad.py", "python", "def (")], "path string, lang string, content string")
    ask = lambda **k: [(r.path, r.s_line, r.captures[0].text) for r in structural.match(files, "python", "(call function: (identifier) @f)", **k).collect()]
    assert ask() == [("a/one.py", 1, "go"), ("b/two.py", 3, "go"), ("b/two.py", 4, "inner"), ("b/two.py", 7, "go")]
    assert ask(limit=2) == ask()[:2] and ask(limit=0) == [] and ask(path="b/") == ask()[1:] and ask(path="B/") == []
    with pytest.raises(ValueError, match="too broad"):
        ask(most_files=2)
    with pytest.raises(patterns.BadPattern):
        structural.match(files.limit(0), "python", "(call)")


def test_workspace_discovery(tmp_path):
    def make(name, git=True, pointer=None):
        folder = tmp_path / name
        folder.mkdir(parents=True)
        if pointer:
            (folder / ".git").write_text(f"gitdir: {pointer}\n")
        elif git:
            (folder / ".git").mkdir()
        return folder

    main = make("w/main")
    make("w/linked", pointer=main / ".git" / "worktrees" / "linked")
    make("w/sub", pointer=main / ".git" / "modules" / "sub")
    for name in ("w/marked", "w/main/inner", "w/node_modules/pkg", "w/a/b/c/deep", "w/a/b/c/d/deeper"):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "package.json").write_text("{}")
    got = workspace.discover(str(tmp_path / "w"))
    assert [(r.name, r.kind) for r in got] == [("deep", "marker"), ("linked", "git"), ("marked", "marker"), ("sub", "git")] or [(r.name, r.kind) for r in got] == [("deep", "marker"), ("main", "git"), ("marked", "marker"), ("sub", "git")]
    assert workspace.main_root(str(tmp_path / "w/linked")) == str(main) and workspace.main_root(str(tmp_path / "w/sub")) is None
    assert [r.path for r in workspace.repos_of(str(main / "inner"))] == [str(main)]
    repos = [workspace.Repo(f"/w/{n}", n, "git") for n in "abcdefghij"]
    assert [r.name for r in workspace.chosen(repos, "c")] == ["c"] and [r.name for r in workspace.chosen(repos, "w/d")] == ["d"] and workspace.chosen(repos, "zz") == []
    assert [r.name for r in workspace.chosen(got, "marked", str(tmp_path))] == ["marked"]
    here = workspace.chosen([workspace.Repo(str(main), "main", "git")], os.path.join("w", "main", "inner"), str(tmp_path))
    assert [r.name for r in here] == ["main"]


def test_workspace_syncs_and_asks(spark, tmp_path):
    for n in range(10):
        (tmp_path / f"w/r{n}/.git").mkdir(parents=True)
    ran = []

    def sync(repo, store):
        ran.append(repo.name)
        return {"repo": repo.name}

    w = workspace.Workspace(spark, str(tmp_path / "w"), str(tmp_path / "stores"), sync, workers=0)
    assert [len(w.select()[0]), w.select()[1], w.select("r3")[0][0].name] == [8, 2, "r3"]
    warm = [w.sync(r, asked=False) for r in w.repos[:3]]
    first = w.sync(w.repos[2])
    assert first is warm[2]  # joins the one that waits, and goes before the others
    import threading

    threading.Thread(target=w._work, daemon=True).start()
    assert [f.result(20)["repo"] for f in warm] == ["r0", "r1", "r2"] and ran == ["r2", "r0", "r1"]
    lines = w.ask(lambda index: ["never"])
    assert lines[0] == "[r0] (index warming up in the background; ask again shortly)" and lines[-1] == "(+2 more repositories not searched; name one to ask it)"
    assert w.ask(lambda index: [], "none") == ['No repository matches "none".']


def test_ages():
    now = datetime(2024, 1, 2, tzinfo=UTC)
    hint = lambda minutes: render.staleness((now - timedelta(minutes=minutes)).isoformat(), now)
    assert hint(15) is None and "16m ago" in hint(16) and "2h ago" in hint(100) and "3d ago" in hint(4400) and render.staleness(None) is None


def random_graph(spark, seed, n=40, m=160):
    r = random.Random(seed)
    files = [(k, f"{'ab'[k % 2]}/{'xYz'[k % 3]}{k}.py", "python") for k in range(7)]
    symbols = [(k, f"n{k % 25}", f"m{k}", k % 7, "go" if k % 9 == 0 else "function") for k in range(n)]
    occ = [(k, r.randrange(n), r.randrange(7), r.randrange(1, 9), r.randrange(5), r.choice(["call", "reference", "extends"]), r.choice([None, *range(n)]), r.choice([0.05, 0.25, 0.5, 1.0]), "syntactic") for k in range(m)]
    return files, symbols, occ, Index(
        spark.createDataFrame(files, "id long, path string, lang string"), spark.createDataFrame(symbols, "id long, name string, moniker string, file_id long, kind string"),
        spark.createDataFrame(occ, "id long, symbol_id long, file_id long, s_line int, s_col int, role string, enclosing_id long, confidence double, provenance string"),
    )


@pytest.mark.parametrize("seed, limit, depth", [(1, 500, 3), (2, 12, 3), (3, 5, 2)])
def test_impact_equals_plain_search(spark, seed, limit, depth):
    files, symbols, occ, index = random_graph(spark, seed)
    path, name, by = {f[0]: f[1] for f in files}, {s[0]: s[1] for s in symbols}, {s[0]: s[2] for s in symbols}
    frontier = sorted(s[0] for s in symbols if s[1] == "n3")
    seen, sources, out = set(frontier), set(), []
    for level in range(1, depth + 1):
        left = limit - len(out)
        if not frontier or left <= 0:
            break
        share, rows, following = max(1, -(-left // len(frontier))), [], []
        for target in frontier:
            sites = [(-o[7], path[o[2]], o[3], o[4], o[0], o[6]) for o in occ if o[1] == target and o[5] != "extends" and o[7] >= 0.1]
            best = {}
            for s in sorted(sites, key=lambda s: s[:5]):
                best.setdefault(s[5], s)
            count = Counter(s[5] for s in sites)
            # a group without a moniker comes first among equals
            for s in sorted(best.values(), key=lambda s: (*s[:4], by.get(s[5]) or ""))[:share]:
                if s[5] not in sources:
                    sources.add(s[5])
                    rows.append((level, name[target], name.get(s[5], "(top level)"), s[5], count[s[5]], -s[0], s[1], s[2], s[3]))
                    if s[5] is not None and s[5] not in seen:
                        seen.add(s[5])
                        following.append(s[5])
        rows.sort(key=lambda r: (-r[5], r[6].casefold(), r[6], r[7], r[8]))
        out += rows[:left]
        frontier = following
    got = [tuple(r)[:-1] for r in graph.impact(index, "n3", depth=depth, limit=limit).collect()]
    assert Counter(got) == Counter(out) if limit == 500 else len(got) == len(out)
    assert [g[0] for g in got] == sorted(g[0] for g in got) and all(a[5] >= b[5] for a, b in zip(got, got[1:]) if a[0] == b[0])


@pytest.mark.parametrize("local", [10**6, 0])
def test_components_of_random_graphs(spark, local):
    r = random.Random(4)
    pairs = sorted({(r.randrange(30), r.randrange(30)) for _ in range(45)} | {(k, k + 1) for k in range(100, 110)} | {(200, 200)})
    reach = {a: {a} for p in pairs for a in p}
    for _ in range(40):
        for a, b in pairs:
            reach[a] |= reach[b]
    want = {frozenset(b for b in reach[a] if a in reach[b]) for a in reach}
    want = {c for c in want if len(c) > 1 or (min(c), min(c)) in pairs}
    got = {}
    for row in graph.strong_components(spark.createDataFrame(pairs, "a long, b long"), local).collect():
        got.setdefault(row.component, set()).add(row.node)
    assert {frozenset(c) for c in got.values()} == want
