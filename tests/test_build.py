"""From source text to edges; ignore rules, banners, snapshots, streams, SCIP."""

import json

import pytest

from loomgraph.operators import graph
from loomgraph.plans.build import build, build_tree
from loomgraph.plans.store import Store
from loomgraph.sources import python_front, scip, tree
from loomgraph.sources.ignore import Rules
from loomgraph.streaming.watch import watch

FILES = {
    "app.py": "from pkg.mod import helper\n\ndef run():\n    helper(1)\n    other()\n",
    "pkg/__init__.py": "",
    "pkg/mod.py": "def helper(x):\n    return x\n\nclass Base:\n    def go(self):\n        return 1\n",
    "pkg/kid.py": "from pkg.mod import Base\n\nclass Kid(Base):\n    def do(self):\n        return self.go()\n",
    "s.py": "def outer():\n    def helper():\n        return 1\n    return helper()\n",
    "bad.py": "def (",
    "gen.py": "# Code generated by a tool. DO NOT EDIT.\ndef helper(): pass\n",
}
EDGES = {("helper", "run", "app.py", 0.9, "syntactic"), ("go", "do", "pkg/kid.py", 0.85, "syntactic"), ("Base", "Kid", "pkg/kid.py", 0.9, "syntactic"), ("helper", "outer", "s.py", 1.0, "scoped")}


def edges(index):
    return {(r.target, r.source, r.path, round(r.confidence, 6), r.provenance) for r in graph.edges(index).collect()}


def test_tree_to_edges_and_scip_round_trip(spark, tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    index = build_tree(spark, str(tmp_path))
    assert edges(index) == EDGES
    (tmp_path / "out").mkdir()
    (tmp_path / "out" / "index.scip").write_bytes(scip.index_bytes(scip.documents(index, "my repo")))
    sources = spark.createDataFrame(list(FILES.items()), "path string, content string")
    back = scip.ingest(scip.decode(scip.read_indexes(spark, str(tmp_path / "out")), sources), index)
    # the two functions named helper have one SCIP symbol each as their files differ; inheritance comes back as a reference
    assert {(r.symbol_id, r.file_id, r.s_line, r.s_col) for r in back.collect()} == {(r.symbol_id, r.file_id, r.s_line, r.s_col) for r in index.occurrences.collect()}
    assert {r.confidence for r in back.collect()} == {0.95}


def by_place(index):
    """Edges without ids: what a rebuild has to give as well."""
    return sorted((r.target, r.source, r.path, r.s_line, r.s_col, r.role, round(r.confidence, 6), r.provenance) for r in graph.edges(index).collect())


def as_files(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, content string")


def test_store_and_stream(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"), "r")
    files = as_files(spark, {k: v for k, v in FILES.items() if k != "s.py"})
    got = store.sync(files)
    assert (got["new"], got["unparsed"], got["resolved"]) == (5, 1, "all")
    first = store.manifest()["version"]
    assert Store(spark, str(tmp_path / "store"), "elsewhere").load() is None
    (tmp_path / "store" / "manifest" / "000000000009.json").write_text("{")  # a sync that died
    assert store.manifest()["version"] == first
    (tmp_path / "store" / "manifest" / "000000000009.json").unlink()
    changes = tmp_path / "changes"
    changes.mkdir()

    def batch(name, rows):
        (changes / name).write_text("\n".join(json.dumps(dict(zip(("path", "content", "seq"), r))) for r in rows))
        stream = spark.readStream.schema("path string, content string, seq long").json(str(changes))
        watch(stream, Store(spark, str(tmp_path / "store"), "r"), files, str(tmp_path / "ckpt"), once=True).awaitTermination()

    batch("1.json", [("s.py", FILES["s.py"], 1), ("app.py", None, 2)])
    assert store.manifest()["version"] != first
    assert edges(store.load()) == {e for e in EDGES if e[2] != "app.py"}
    batch("2.json", [("app.py", FILES["app.py"], 3)])  # another process goes on where the first one ended
    assert edges(store.load()) == EDGES
    assert len(list((tmp_path / "store" / "manifest").glob("*.json"))) == 2


EDITS = [
    ("a declaration moves and a name appears", {"pkg/mod.py": "\n" + FILES["pkg/mod.py"], "more.py": "def other():\n    pass\n"}, "scoped"),
    ("a base changes and a file goes", {"pkg/kid.py": FILES["pkg/kid.py"].replace("(Base)", ""), "s.py": None}, "all"),
    ("nothing", {}, "none"),
]


def test_scoped_syncs_equal_rebuilds(spark, tmp_path):
    store, files = Store(spark, str(tmp_path / "store")), dict(FILES)
    store.sync(as_files(spark, files))
    for what, edit, way in EDITS:
        files = {k: v for k, v in (files | edit).items() if v is not None}
        got = store.sync(as_files(spark, files))
        assert got["resolved"] == way, what
        assert got["changed"] + got["gone"] == sum(k in FILES for k in edit) and got["unparsed"] == 1, what  # bad.py is tried each time
    assert by_place(store.load()) == by_place(build(as_files(spark, files)))
    assert store.verify(as_files(spark, files | {"app.py": "x = 1\n"})) == {"changed": 1, "new": 1, "gone": 0}  # bad.py is never indexed


def test_ignore_files_and_aliases_are_read_from_the_tree(spark, tmp_path):
    texts = {
        "tsconfig.json": '{ // aliases\n "compilerOptions": {"paths": {"@app/*": ["src/*"]}} }', ".gitignore": "ignored/\n*.tmp.ts\n!keep.tmp.ts\n", "src/.gitignore": "local.ts\n",
        "src/util.ts": "export function tool(a: number) { return a; }\n", "src/main.ts": "import { tool } from '@app/util';\nexport function main() { return tool(1); }\n", "src/local.ts": "export function tool() {}\n",
        "ignored/x.ts": "export function tool() {}\n", "a.tmp.ts": "x();\n", "keep.tmp.ts": "main();\n", "nested/.git/HEAD": "x", "nested/n.ts": "export function tool() {}\n", "node_modules/m.ts": "", "src/util.js": "function tool() {}\n",
    }
    for name, text in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "link.ts").symlink_to(tmp_path / "src/util.ts")
    index = build_tree(spark, str(tmp_path))
    assert {r.path for r in index.files.collect()} == {"src/util.ts", "src/main.ts", "keep.tmp.ts"}
    assert ("tool", "main", "src/main.ts", 0.9, "syntactic") in edges(index)
    listing = tree.list_tree(spark, str(tmp_path))
    assert [r.path for r in listing.orderBy("visit").collect()][:3] == [".gitignore", "keep.tmp.ts", "tsconfig.json"]
    chosen, more = tree.first_of(tree.indexable(listing), 2)
    assert more and [r.path for r in chosen.collect()] == ["keep.tmp.ts", "src/main.ts"]
    assert tree.contained(str(tmp_path), "src/main.ts") and not tree.contained(str(tmp_path), "link.ts") and not tree.contained(str(tmp_path), "../x")


def test_a_mixed_tree_resolves_across_files(spark):
    files = {
        "go.mod": "module example.org/m\n", "cmd/main.go": 'package main\nimport "example.org/m/util"\nfunc main() { util.Do(1); side() }\n', "cmd/side.go": "package main\nfunc side() {}\n", "util/u.go": "package util\nfunc Do(a int) {}\n",
        "j/Main.java": "package j;\nimport k.Tool;\nclass Main extends Tool { void go() { Tool.run(1); this.stay(); } }\n", "k/Tool.java": "package k;\npublic class Tool { static void run(int a) {} void stay() {} }\n",
        "r.rb": "class Vehicle\n  def drive(a)\n  end\nend\nclass Car < Vehicle\n  def go\n    drive 1\n  end\nend\n", "k.kt": "open class Base { fun b() {} }\nclass D : Base() { fun d() { helper(1) } }\nfun helper(a: Int) {}\n",
    }
    from loomgraph.plans.build import Layout

    got = {(t, s, c) for t, s, _, c, _ in edges(build(as_files(spark, files), layout=Layout.of(None, files["go.mod"])))}
    assert {("Do", "main", 0.9), ("side", "main", 0.85), ("run", "go", 0.9), ("Tool", "Main", 0.9), ("stay", "go", 0.85), ("Vehicle", "Car", 1.0), ("Base", "D", 1.0), ("helper", "d", 1.0)} <= got


def test_python_facts_are_in_utf16():
    got = python_front.parse('x = "😀é"; tail(1, *a)\n\nclass K(m.B[int]):\n    @staticmethod\n    def _p(a, *, b): pass\n')
    call = next(r for r in got["refs"] if r["name"] == "tail")
    assert call["range"] == (1, 11, 1, 15) and call["arg_count"] == 2
    base = next(r for r in got["refs"] if r["role"] == "extends")
    assert (base["name"], base["receiver"]) == ("B", "m")
    method = next(s for s in got["symbols"] if s["name"] == "_p")
    assert (method["owner_type"], method["visibility"], method["is_static"], method["param_count"]) == ("K", "protected", True, 2)
    assert python_front.parse("def (") is None


@pytest.mark.parametrize(
    "path, ignored",
    [("a.log", True), ("keep.log", False), ("sub/x.log", True), ("build/keep.log", True), ("sub/only.txt", True), ("other/only.txt", False), ("d/e/f.tmp", True), ("doc/a/b.md", True), ("x/doc/b.md", False), ("A.LOG", False)],
)
def test_ignore_rules(path, ignored):
    rules = Rules({"": "*.log\n!keep.log\nbuild/\n# note\n\n**/*.tmp\n/doc/**\n", "sub": "only.txt\n"})
    assert rules.ignores(path) is ignored


def test_banners_and_precedence(spark):
    assert tree.has_generated_banner("#!/bin/sh\n\n/* x\n * @generated */\ncode")
    assert not tree.has_generated_banner("x = 1\n# do not edit\n") and not tree.has_generated_banner("# about generated code\n")
    files = spark.createDataFrame([(p,) for p in ("a/p.js", "a/p.ts", "a/q.js", "b/p.js", "c.mjs", "c.mts", "d.jsx", "d.tsx")], "path string")
    assert {r.path for r in tree.precedence_losers(files).collect()} == {"a/p.js", "c.mjs", "d.jsx"}


def test_utf_columns():
    line = "😀 tail"
    assert [scip.placed((0, a, 0, b), e, [line]) for a, b, e in ((5, 9, scip.UTF8), (3, 7, scip.UTF16), (2, 6, scip.UTF32))] == [(1, 3, 1, 7)] * 3
    assert scip.placed((0, 1, 0, 5), scip.UTF16, [line]) is None and scip.placed((0, 3, 0, 7), 0, [line]) is None
    assert scip.placed((0, 0, 0, 2), 0, ["ab"]) == (1, 0, 1, 2) and scip.placed((0, 2, 0, 2), 0, ["ab"]) is None and scip.placed((1, 0, 1, 1), 0, ["ab"]) is None


def test_build_of_an_empty_tree(spark):
    index = build(spark.createDataFrame([], "path string, content string"))
    assert index.occurrences.count() == 0 and index.symbols.count() == 0


def hand_made(spark, files, symbols, refs, imports):
    from loomgraph.schemas import Index

    f = spark.createDataFrame(files, "id long, path string, lang string")
    s = spark.createDataFrame(symbols, "id long, file_id long, name string, exported boolean, export_name string")
    r = spark.createDataFrame(refs, "id long, file_id long, name string, receiver string")
    i = spark.createDataFrame(imports, "id long, file_id long, source string, kind string, imported_name string, local_name string")
    return Index(f, s, None, r, i)


def found(df):
    return sorted((r.ref_id, r.symbol_id, r.base) for r in df.collect())


def test_ecmascript_imports_follow_reexports(spark):
    from loomgraph.operators import resolve

    x = hand_made(
        spark,
        [(1, "src/main.ts", "typescript"), (2, "src/lib/index.ts", "typescript"), (3, "src/lib/deep.ts", "typescript"), (4, "src/util.ts", "typescript"), (5, "src/loop.ts", "typescript")],
        [(10, 3, "run", True, None), (11, 3, "hidden", False, None), (12, 4, "tool", True, "default"), (13, 3, "go", True, None)],
        [(100, 1, "start", None), (101, 1, "go", "ns"), (102, 1, "t", None), (103, 1, "hidden", None), (104, 1, "never", None)],
        [
            (1, 1, "./lib", "named", "begin", "start"), (2, 1, "./lib", "namespace", None, "ns"), (3, 1, "@app/util", "default", "default", "t"), (4, 1, "./lib/deep.js", "named", "hidden", "hidden"), (5, 2, "./deep", "reexport", "run", "begin"),
            (6, 2, "./deep", "reexport-star", None, None), (7, 1, "./loop", "named", "never", "never"), (8, 5, "./loop", "reexport-star", None, None),
        ],
    )
    at = x.imports.join(x.files.selectExpr("id as file_id", "path"), "file_id").select("id", "path", "source")
    module = resolve.first_existing(resolve.module_candidates(at, [("@app/", True, ["src/*"])]), x.files)
    assert {(r.id, r.file_id) for r in module.collect()} == {(1, 2), (2, 2), (3, 4), (4, 3), (5, 3), (6, 3), (7, 5), (8, 5)}
    assert found(resolve.bind_ecmascript(x.refs, x, module)) == [(100, 10, 0.9), (101, 13, 0.9), (102, 12, 0.9)]


def test_go_packages(spark):
    from loomgraph.operators import resolve

    x = hand_made(
        spark,
        [(1, "cmd/main.go", "go"), (2, "pkg/util/u.go", "go"), (3, "cmd/side.go", "go"), (4, "dot/d.go", "go")],
        [(10, 2, "Do", True, None), (11, 2, "do", False, None), (12, 3, "helper", False, None), (13, 4, "Dotted", True, None), (14, 1, "helper", False, None)],
        [(100, 1, "Do", "util"), (101, 1, "do", "util"), (102, 1, "helper", None), (103, 1, "Dotted", None), (104, 1, "Do", "other")],
        [(1, 1, "example.org/m/pkg/util", "namespace", None, "util"), (2, 1, "elsewhere.org/x/dot", "wildcard", None, None)],
    )
    want = [(100, 10, 0.9), (102, 12, 0.85), (103, 13, 0.9)]
    assert found(resolve.bind_go(x.refs, x, "example.org/m")) == want and found(resolve.bind_go(x.refs, x)) == want


def test_command_line(spark, tmp_path, capsys):
    from loomgraph.__main__ import main, parser

    src = tmp_path / "src"
    for name, text in (FILES | {"a.ts": "import './b';\nexport function one() { return two(1); }\n", "b.ts": "import './a';\nexport function two(n: number) {}\n"}).items():
        (src / name).parent.mkdir(parents=True, exist_ok=True)
        (src / name).write_text(text)
    store = ["--store", str(tmp_path / "store")]
    assert main([*store, "status"]) == 1
    assert main([*store, "sync", str(src)]) == 0
    capsys.readouterr()

    def say(*words):
        assert main([*store, *words]) == 0
        return capsys.readouterr().out.splitlines()

    assert say("callers", "helper", "--limit", "5") == ["outer → helper  s.py:4  [scoped, 1.00]", "run → helper  app.py:4  [syntactic, 0.90]"]
    assert say("callers", "nobody") == ['no symbol named "nobody" (not indexed; sync if it is new)'] and say("callers", "run") == ['"run" is indexed (1 definition(s)) but has no matching edges']
    assert say("explore", "Kid", "--root", str(src))[:3] == [say("def", "Kid")[0], "class Kid(Base):", "    def do(self):"]
    assert say("explore", "helper")[0].startswith("2 candidates") and say("implementers", "Base") == ["Kid extends Base  pkg/kid.py:3  [syntactic, 0.90]"]
    assert say("impact", "helper")[0] == "direct outer → helper  s.py:4  [scoped, 1.00]"
    assert say("cycles") == ["cycle group (2 files): a.ts, b.ts"]
    assert say("match", "(call function: (identifier) @f (#eq? @f \"helper\"))", "--lang", "python", "--root", str(src)) == ["app.py:4  f=helper", "s.py:4  f=helper"]
    assert main([*store, "match", "(call", "--lang", "python", "--root", str(src)]) == 1
    (src / "app.py").write_text("x = 1\n")
    assert {"files 7", "changed 1", "gone 0"} <= set(say("status", "--verify", str(src)))
    (src / "app.py").write_text(FILES["app.py"])
    say("scip", str(tmp_path / "index.scip"))
    before = len(say("refs", "helper"))
    assert int(say("scip-import", str(tmp_path / "index.scip"), "--root", str(src))[0].split()[0]) >= 4
    assert any("scip, 0.95" in line for line in say("refs", "helper")) and len(say("refs", "helper")) == before
    assert "missed 0" in say("scip-eval", str(tmp_path / "index.scip"), "--root", str(src))
    (src / "new.py").write_text("def fresh(): pass\n")
    main([*store, "sync", str(src)])
    assert "'new': 2" in capsys.readouterr().out and any("scip, 0.95" in line for line in say("refs", "helper"))  # ingested edges outlive a sync; bad.py is tried anew
    for bad in (["callers"], ["callers", "a", "--moniker", "b"], ["def", "a", "--limit", "501"], ["impact", "a", "--depth", "0"], ["nothing"], ["sync", "x", "--max-files", "100001"]):
        with pytest.raises(SystemExit):
            parser().parse_args([*store, *bad])


def test_java_imports(spark):
    from loomgraph.operators import resolve

    x = hand_made(
        spark,
        [(1, "src/a/Main.java", "java"), (2, "src/b/Tool.java", "java"), (3, "src/a/Side.java", "java"), (4, "src/c/Wide.java", "java")],
        [(10, 2, "run", True, None), (11, 3, "near", True, None), (12, 4, "wide", True, None), (13, 2, "Tool", True, None), (14, 3, "run", True, None)],
        [(100, 1, "run", "Tool"), (101, 1, "near", "Side"), (102, 1, "wide", "Wide"), (103, 1, "Tool", None), (104, 1, "near", None), (105, 1, "absent", "Tool"), (106, 1, "run", None)],
        [(1, 1, "b", "named", "Tool", "Tool"), (2, 1, "c", "wildcard", None, None)],
    )
    x = type(x)(x.files, x.symbols, None, x.refs, x.imports.selectExpr("*", "false AS is_static"))
    assert found(resolve.bind_java(x.refs, x)) == [(100, 10, 0.9), (101, 11, 0.85), (102, 12, 0.9), (103, 13, 0.9), (104, 11, 0.85), (106, 14, 0.85)]


def test_layout():
    from loomgraph.plans.build import Layout

    got = Layout.of('{ // note\n "compilerOptions": {"baseUrl": "src", "paths": {"@app/*": ["src/*",], "x": ["y"]},},}', "module example.org/m // here\n\ngo 1.22\n")
    assert got == Layout((("@app/", True, ("src/*",)), ("x", False, ("y",))), "src", "example.org/m")
    assert Layout.of("{", None) == Layout()
