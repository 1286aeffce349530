"""Command line: sync a folder, then ask. python -m loomgraph --store S sync DIR; python -m loomgraph --store S callers NAME"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluate, graph, lookup, render, search, structural
from .plans.build import Layout, import_edges, layout_of, typed
from .plans.store import Store
from .schemas import FILE_CAP, MAX_BUDGET, MAX_DEPTH, MAX_FILES, MAX_RESULTS, TYPED_FILE_CAP, Index, limited
from .sources import patterns, scip, tree

EDGES = ("callers", "callees", "refs")
RELATIONS = ("implementers", "supertypes")


def number(most: int):
    def parse(text: str) -> int:
        try:
            return limited(int(text), most, "the value")
        except ValueError as e:
            raise argparse.ArgumentTypeError(str(e)) from None

    return parse


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="loomgraph")
    p.add_argument("--store", required=True)
    verbs = p.add_subparsers(dest="verb", required=True)
    v = verbs.add_parser("sync")
    v.add_argument("root")
    v.add_argument("--max-files", type=number(MAX_FILES))
    v.add_argument("--typed", metavar="TABLE", help="what a compiler knows: Parquet of path, line, col, def_path, def_line, def_col")
    verbs.add_parser("status").add_argument("--verify", metavar="DIR")
    for verb in ("search", "def", *RELATIONS, "files"):
        v = verbs.add_parser(verb)
        v.add_argument("name", nargs="?" if verb == "files" else None)
        v.add_argument("--limit", type=number(MAX_RESULTS), default=20)
    for verb in (*EDGES, "impact", "explore"):
        v = verbs.add_parser(verb)
        which = v.add_mutually_exclusive_group(required=True)
        which.add_argument("name", nargs="?")
        which.add_argument("--moniker")
        v.add_argument("--limit", type=number(MAX_RESULTS), default=20)
        v.add_argument("--depth", type=number(MAX_DEPTH), default=2)
        v.add_argument("--budget", type=number(MAX_BUDGET), default=6000)
        v.add_argument("--root")
    v = verbs.add_parser("match")
    v.add_argument("pattern")
    v.add_argument("--lang", required=True)
    v.add_argument("--path")
    v.add_argument("--root", required=True)
    v.add_argument("--limit", type=number(MAX_RESULTS), default=20)
    verbs.add_parser("cycles")
    v = verbs.add_parser("scip")
    v.add_argument("out")
    v.add_argument("--repo", default="")
    for verb in ("scip-import", "scip-eval"):
        v = verbs.add_parser(verb)
        v.add_argument("index")
        v.add_argument("--root", required=True)
    return p


def sync(spark: SparkSession, store: Store, root: str, cap: int | None = None, typed_table: str | None = None) -> dict:
    """Bring the store to a folder, by its ignore files, layout and cap."""
    chosen, more = tree.first_of(tree.indexable(tree.list_tree(spark, root)), cap or (TYPED_FILE_CAP if typed_table else FILE_CAP))
    providers = (typed(spark.read.parquet(typed_table)),) if typed_table else ()
    return store.sync(tree.read_files(chosen, root), layout_of(root), providers=providers, truncated=more)


def sources(spark: SparkSession, index: Index, root: str):
    """The index's files with their present content."""
    return tree.read_files(index.files.select("path", "lang"), root)


def answer(spark: SparkSession, store: Store, index: Index, a: argparse.Namespace) -> list[str]:
    if a.verb == "status":
        r, m = lookup.status_counts(index).first(), store.manifest()
        out = [f"files {r['files']}", f"symbols {r['symbols']}", f"occurrences {r['occurrences']}", f"synced at {m['synced_at']}"]
        out += ["the file cap was reached"] if m.get("truncated") else []
        if a.verify:
            chosen = tree.first_of(tree.indexable(tree.list_tree(spark, a.verify)))[0]
            out += [f"{k} {n}" for k, n in store.verify(tree.read_files(chosen, a.verify)).items()]
        return out
    if a.verb == "search":
        return render.lines_of(search.search(index, a.name, a.limit), render.symbol_line()) or ["(no results)"]
    if a.verb == "def":
        return render.lines_of(lookup.definitions(index, a.name, a.limit), render.symbol_line()) or [render.diagnosis(index, a.name)]
    if a.verb == "files":
        return render.lines_of(lookup.files_like(index, a.name, a.limit), F.col("path")) or ["(no results)"]
    if a.verb in EDGES:
        return render.edge_lines(index, a.verb, a.name, a.moniker, a.limit)
    if a.verb in RELATIONS:
        return render.edge_lines(index, a.verb, a.name, None, a.limit)
    if a.verb == "impact":
        rows = graph.impact(index, a.name, a.moniker, a.depth, a.limit)
        line = render.occurrence_line(F.concat("source", F.lit(" → "), "target"), F.col("path"), F.col("s_line"), F.col("provenance"), F.col("confidence"), F.col("sites"), F.col("depth"))
        return render.lines_of(rows, line) or ([render.diagnosis(index, a.name)] if a.name else ["(no results)"])
    if a.verb == "explore":
        return render.exploration(index, a.budget, a.name, a.moniker, (lambda path: tree.read_text(a.root, path)) if a.root else (lambda path: None))
    if a.verb == "match":
        return render.lines_of(structural.match(sources(spark, index, a.root), a.lang, a.pattern, a.path, a.limit), structural.match_line()) or ["(no results)"]
    if a.verb == "cycles":
        layout = Layout.from_json(store.manifest().get("layout"))
        groups = graph.cycles(graph.strong_components(import_edges(index, layout)), index.files.select(F.col("id").alias("node"), "path"))
        return render.lines_of(groups, render.cycle_line(F.col("size"), F.col("files"))) or ["(no import cycles)"]
    if a.verb == "scip":
        data = scip.index_bytes(scip.documents(index, a.repo))
        with open(a.out, "wb") as f:
            f.write(data)
        return [f"{len(data)} bytes"]
    decoded = scip.decode(scip.read_indexes(spark, a.index), sources(spark, index, a.root).select("path", "content"))
    if a.verb == "scip-import":
        store.ingest(lambda x: scip.ingest(decoded, x))
        return [f"{store.table('scip').count()} edges"]
    row = evaluate.accuracy(store.raw().occurrences, scip.ingest(decoded, store.raw())).first()
    return [f"{k} {v}" for k, v in row.asDict().items()]


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("loomgraph").getOrCreate()
    store = Store(spark, a.store)
    if a.verb == "sync":
        print(sync(spark, store, a.root, a.max_files, a.typed))
        return 0
    index = store.load()
    if index is None:
        print("the store holds no index yet", file=sys.stderr)
        return 1
    try:
        lines = answer(spark, store, index, a)
    except patterns.BadPattern as e:
        print(f"structural search: invalid query for {a.lang}: {e}", file=sys.stderr)
        return 1
    print("\n".join(lines))
    return 0


if __name__ == "__main__":
    sys.exit(main())
