"""Code-graph operators: every registered query against DuckDB, and small cases with known answers."""

import itertools
import math
import random

import duckdb
import pandas as pd
import pytest

from loomgraph import queries as Q
from loomgraph.functions import ident, paths
from loomgraph.operators import graph, lookup, resolve, search
from loomgraph.plans.proxy import proxy
from loomgraph.schemas import Index

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canon(df):
    cell = lambda v: "null" if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)) else str(round(float(v), 9)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v)
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query_equals_sql(spark, duck, name):
    got = Q.queries()[name](spark, SF).toPandas()
    want = duck.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.fixture(scope="module")
def repeated(tmp_path_factory):
    """The tables six times over with shifted keys: each name has six times the symbols, and monikers repeat."""
    to, con = tmp_path_factory.mktemp("repeated"), duckdb.connect()
    keys = {"supplier": {"s_suppkey": "supplier"}, "part": {"p_partkey": "part"}, "orders": {"o_orderkey": "orders"}, "lineitem": {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}}
    own = {t: next(iter(k)) for t, k in keys.items() if t != "lineitem"}
    step = {t: con.execute(f"SELECT max({k}) + 1 FROM '{SF}/{t}.parquet'").fetchone()[0] for t, k in own.items()}
    for t, shifted in keys.items():
        moved = ", ".join(f"{k} + i * {step[of]} AS {k}" for k, of in shifted.items())
        con.execute(f"COPY (SELECT t.* REPLACE ({moved}) FROM '{SF}/{t}.parquet' t, range(6) r(i)) TO '{to}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{to}/{t}.parquet'")
    return str(to), con


@pytest.mark.parametrize("name", ["impact_groups", "impact_direct", "known_occurrences", "weight_candidates", "scip_round_trip"])
def test_query_equals_sql_on_repeated_tables(spark, repeated, name):
    to, con = repeated
    got, want = Q.queries()[name](spark, to).toPandas(), con.execute(Q.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_monikers(spark):
    rows = [("app.ts", None, "Foo", "class", 1, 0), ("app.ts", "Foo", "bar", "method", 3, 2), ("u.ts", None, "x", "constant", 2, 4), ("f.ts", None, "A#b", "field", 1, 0), ("f.ts", None, "a`b", "module", 1, 0)]
    df = spark.createDataFrame(rows, "path string, owner string, name string, kind string, line int, col int")
    got = [r[0] for r in df.select(ident.moniker(*[df[c] for c in df.columns])).collect()]
    assert got == ["app.ts#Foo#@1:0", "app.ts#Foo#bar().@3:2", "u.ts#x.@2:4", "f.ts#`A#b`.@1:0", "f.ts#`a``b`/@1:0"]


def test_paths(spark):
    rows = [
        ("src/a.ts", False, False, True, "typescript"), ("node_modules/a.js", True, False, True, "javascript"), ("src/.x/b.py", True, False, True, "python"), ("a/CodeGen/b.go", False, True, True, "go"),
        ("a/x.pb.go", False, True, True, "go"), ("a/x_pb2.py", False, True, True, "python"), ("types.d.ts", False, True, True, "typescript"), ("../x.rs", True, False, False, "rust"), ("/x.c", False, False, False, "c"),
        ("C:/x.c", False, False, False, "c"), ("a//b.kt", False, False, False, "kotlin"), ("Makefile", False, False, True, None), ("codegen", False, False, True, None),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], "p string")
    got = df.select("p", paths.is_pruned(df.p), paths.is_generated_path(df.p), paths.is_safe(df.p), paths.language(df.p)).collect()
    assert [tuple(r) for r in got] == rows
    norm = spark.createDataFrame([("a/./b/../c",), ("../a",), ("a/../../b",), ("",)], "p string")
    assert [r[0] for r in norm.select(paths.normalised(norm.p)).collect()] == ["a/c", "../a", "../b", ""]


def small_index(spark, names, occurrences):
    """names: one symbol each; occurrences: (target, enclosing or None, path, line, role, score, provenance)."""
    files = sorted({o[2] for o in occurrences} | {"f"})
    f = spark.createDataFrame([(k, p, "python") for k, p in enumerate(files)], "id long, path string, lang string")
    s = spark.createDataFrame([(k, f"f#{n}@{k}", 0, n, "function", k, 0, True) for k, n in enumerate(names)], "id long, moniker string, file_id long, name string, kind string, s_line int, s_col int, exported boolean")
    at = {n: k for k, n in enumerate(names)}
    rows = [(k, at[t], files.index(p), line, 0, r, None if e is None else at[e], pr, c) for k, (t, e, p, line, r, c, pr) in enumerate(occurrences)]
    o = spark.createDataFrame(rows, "id long, symbol_id long, file_id long, s_line int, s_col int, role string, enclosing_id long, provenance string, confidence double")
    return Index(f, s, o)


def test_impact_levels_and_sites(spark):
    call = lambda t, e, line: (t, e, "f", line, "call", 1.0, "scoped")
    x = small_index(spark, ["target", "hot", "sibling", "mid", "top"], [call("target", "hot", 1), call("target", "hot", 2), call("target", "hot", 3), call("target", "sibling", 4), call("hot", "mid", 5), call("mid", "top", 6), call("target", "target", 7), call("hot", None, 8)])
    got = [(r.depth, r.source, r.sites) for r in graph.impact(x, "target", depth=3, limit=20).collect()]
    assert sorted(got) == [(1, "hot", 3), (1, "sibling", 1), (1, "target", 1), (2, "(top level)", 1), (2, "mid", 1), (3, "top", 1)]
    assert len(graph.impact(x, "target", depth=3, limit=4).collect()) == 4
    with pytest.raises(ValueError):
        graph.impact(x, "target", depth=11)


def test_impact_direct_has_every_row(spark):
    x = small_index(spark, [Q.SEED_NAME] + [f"c{k}" for k in range(600)], [(Q.SEED_NAME, f"c{k}", "f", k, "call", 1.0, "scoped") for k in range(600)])
    assert sorted(r.s_line for r in Q.impact_direct(x).collect()) == list(range(600))


def test_order_prefers_score_then_provenance_then_path(spark):
    x = small_index(spark, ["t", "a"], [("t", "a", "z", 1, "call", 0.9, "typed"), ("t", "a", "b", 9, "call", 0.9, "syntactic"), ("t", "a", "a", 9, "call", 0.9, "syntactic"), ("t", "a", "q", 1, "call", 1.0, "syntactic")])
    assert [r.path for r in graph.callers(x, "t").collect()] == ["q", "z", "a", "b"]
    with pytest.raises(ValueError):
        graph.callers(x)


def test_weights(spark):
    rows = [(1, k, "name", 0.5) for k in range(8)] + [(2, k, "name", 0.5) for k in range(9)] + [(3, k, "import", 0.9) for k in range(2)] + [(3, 9, "name", 0.5), (4, 1, "name", 0.5), (5, 1, "import", 0.9)]
    got = resolve.weight_targets(spark.createDataFrame(rows, "ref_id long, symbol_id long, resolution string, base double")).collect()
    by = {k: sorted(r.confidence for r in v) for k, v in itertools.groupby(sorted(got, key=lambda r: r.ref_id), key=lambda r: r.ref_id)}
    assert by == {1: [0.0625] * 8, 3: [0.45] * 2, 4: [0.5], 5: [0.9]}


def test_weights_of_a_name_are_never_shuffled_per_reference(spark):
    """The only window is over the symbols, below the join with the references."""
    plan = Q.queries()["weight_candidates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Window")


def test_scip_round_trip_brings_nothing_together(spark):
    """Neither all documents in one row nor all source texts on the driver."""
    plan = Q.queries()["scip_round_trip"](spark, SF)._jdf.queryExecution().toString()
    joins = [line for line in plan.partition("== Physical Plan ==")[2].splitlines() if "collect_list(document" in line or "repeat(" in line and "BroadcastExchange" in line]
    last = next(line for line in plan.partition("== Physical Plan ==")[2].splitlines() if "Join" in line)
    assert not joins and "SortMergeJoin" in last


def tarjan_like(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: set() for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            for a, b in edges:
                if a == todo[-1] and b not in reach[n]:
                    reach[n].add(b)
                    todo.insert(0, b)
            todo.pop()
    return {frozenset(m for m in nodes if m in reach[n] and n in reach[m]) for n in nodes if n in reach[n]}


@pytest.mark.parametrize("seed", range(3))
def test_cycles_equal_brute_force(spark, seed):
    r = random.Random(seed)
    edges = list({(r.randrange(18), r.randrange(18)) for _ in range(26)})
    got = {}
    for row in graph.strong_components(spark.createDataFrame(edges, "a long, b long")).collect():
        got.setdefault(row.component, set()).add(row.node)
    assert {frozenset(v) for v in got.values()} == tarjan_like(edges)


def test_search_order(spark):
    x = small_index(spark, ["parse_config", "parseConfigFile", "cfgPrsr"], [("parse_config", None, "f", 1, "call", 1.0, "typed")])
    assert search.terms("a parse_config x! " + "y9 " * 20) == ["parse_config"] + ["y9"] * 7
    assert [r.name for r in search.search(x, "parse_config").collect()][0] == "parse_config"
    assert [r.name for r in search.search(x, "cfgp").collect()][0] == "cfgPrsr"
    assert search.search(x, "!").count() == 0


def test_files_like_wildcards(spark):
    x = proxy(spark, SF)
    assert lookup.files_like(x, "S1.PY").count() == 1 and lookup.files_like(x).count() == 10
