"""Edge queries: callers, callees, references, hierarchy, impact, import cycles."""

from __future__ import annotations

import functools
import itertools
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut
from ..schemas import CALL_ROLES, IMPACT_FLOOR, INHERITANCE_ROLES, MAX_DEPTH, MAX_RESULTS, PROVENANCE_RANK, TOP_LEVEL, Index, limited


def provenance_rank(provenance: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for x in chain.from_iterable(PROVENANCE_RANK.items())]), provenance), F.lit(0))


def in_order(rows: DataFrame, limit: int) -> DataFrame:
    """Best score first, then provenance, path and place."""
    return rows.orderBy(F.desc("confidence"), F.desc(provenance_rank(F.col("provenance"))), "path", "s_line", "s_col", "id").limit(limited(limit, MAX_RESULTS))


def _chosen(index: Index, name: str | None, moniker: str | None) -> DataFrame:
    if (name is None) == (moniker is None):
        raise ValueError("either a name or a moniker")
    return index.symbols.where(F.col("name") == name if name is not None else F.col("moniker") == moniker)


def edges(index: Index, roles: tuple[str, ...] | None = None) -> DataFrame:
    """Every edge with its target's and its enclosing symbol's name (TOP_LEVEL outside of any) and its path."""
    o = index.occurrences if roles is None else index.occurrences.where(F.col("role").isin(*roles))
    target = index.symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("target"))
    source = index.symbols.select(F.col("id").alias("enclosing_id"), F.col("name").alias("source"))
    files = index.files.select(F.col("id").alias("file_id"), "path")
    return o.join(target, "symbol_id").join(files, "file_id").join(source, "enclosing_id", "left").withColumn("source", F.coalesce("source", F.lit(TOP_LEVEL)))


def incoming(index: Index, roles: tuple[str, ...] | None, name: str | None = None, moniker: str | None = None, limit: int = 20) -> DataFrame:
    ids = _chosen(index, name, moniker).select(F.col("id").alias("symbol_id"))
    narrowed = Index(index.files, index.symbols, index.occurrences.join(ids, "symbol_id", "left_semi"))
    return in_order(edges(narrowed, roles), limit)


def outgoing(index: Index, roles: tuple[str, ...], name: str | None = None, moniker: str | None = None, limit: int = 20) -> DataFrame:
    """Sites outside of any symbol have no source and don't count."""
    ids = _chosen(index, name, moniker).select(F.col("id").alias("enclosing_id"))
    narrowed = Index(index.files, index.symbols, index.occurrences.join(ids, "enclosing_id", "left_semi"))
    return in_order(edges(narrowed, roles), limit)


def callers(index: Index, name: str | None = None, moniker: str | None = None, limit: int = 20) -> DataFrame:
    return incoming(index, CALL_ROLES, name, moniker, limit)


def callees(index: Index, name: str | None = None, moniker: str | None = None, limit: int = 20) -> DataFrame:
    return outgoing(index, CALL_ROLES, name, moniker, limit)


def references(index: Index, name: str | None = None, moniker: str | None = None, limit: int = 20) -> DataFrame:
    return incoming(index, None, name, moniker, limit)


def implementers(index: Index, name: str, limit: int = 20) -> DataFrame:
    return incoming(index, INHERITANCE_ROLES, name, None, limit)


def supertypes(index: Index, name: str, limit: int = 20) -> DataFrame:
    return outgoing(index, INHERITANCE_ROLES, name, None, limit)


def impact_groups(index: Index, floor: float = IMPACT_FLOOR) -> DataFrame:
    """Per (target, enclosing): sites, best score, and the best site's place. Top-level sites of a target are one group."""
    o = index.occurrences.where(F.col("role").isin(*CALL_ROLES) & (F.col("confidence") >= floor)).join(index.files.select(F.col("id").alias("file_id"), "path"), "file_id")
    best = F.min(F.struct((-F.col("confidence")).alias("c"), F.col("path"), F.col("s_line"), F.col("s_col"), F.col("id").alias("oid"), F.col("provenance"))).alias("b")
    return o.groupBy("symbol_id", "enclosing_id").agg(F.count("*").alias("sites"), best).select(
        "symbol_id", "enclosing_id", "sites", (-F.col("b.c")).alias("confidence"), "b.path", "b.s_line", "b.s_col", "b.provenance"
    )


def impact_rows(index: Index, front: DataFrame, share: int | None = None) -> DataFrame:
    """A frontier's (pos, symbol_id) groups with names: of each symbol the ``share`` best, all of them without one; of a source that
    several targets have the first row. Edges are narrowed to the frontier before they are grouped."""
    names = index.symbols.select(F.col("id").alias("symbol_id"), F.col("name").alias("target"))
    sources = index.symbols.select(F.col("id").alias("enclosing_id"), F.col("name").alias("source"), F.col("moniker").alias("by"))
    groups = impact_groups(Index(index.files, index.symbols, index.occurrences.join(front.select("symbol_id"), "symbol_id", "left_semi")))
    w = Window.partitionBy("pos").orderBy(F.desc("confidence"), "path", "s_line", "s_col", "by")
    rows = groups.join(front, "symbol_id").join(sources, "enclosing_id", "left").withColumn("rn", F.row_number().over(w))
    rows = (rows if share is None else rows.where(F.col("rn") <= share)).join(names, "symbol_id")
    once = Window.partitionBy("enclosing_id").orderBy("pos", "rn")
    return rows.withColumn("again", F.row_number().over(once)).where("again = 1")


def impact(index: Index, name: str | None = None, moniker: str | None = None, depth: int = 2, limit: int = 20) -> DataFrame:
    """Reverse calls, level by level. Every frontier symbol may give a fair share of the rows that are left; rows seen before use
    up share as well. All top-level sites are one row. At most ``limit`` ids are kept between levels. The seeds, all symbols of a
    name, stay a table."""
    limited(depth, MAX_DEPTH, "depth")
    limited(limit, MAX_RESULTS)
    spark = index.symbols.sparkSession
    seeds = _chosen(index, name, moniker).select(F.col("id").alias("pos"), F.col("id").alias("symbol_id"))
    front, size = seeds, seeds.count()
    seen_symbols, seen_sources, out = set(), set(), []
    for level in range(1, depth + 1):
        left = limit - len(out)
        if not size or left <= 0:
            break
        share = max(1, -(-left // size))
        rows = impact_rows(index, F.broadcast(front) if level > 1 else front, share)
        if seen_sources:
            known = [i for i in seen_sources if i is not None]
            rows = rows.where(~F.col("enclosing_id").isin(known) if None in seen_sources else F.col("enclosing_id").isNull() | ~F.col("enclosing_id").isin(known))
        rows = rows.join(seeds.select(F.col("symbol_id").alias("enclosing_id"), F.lit(True).alias("seed")), "enclosing_id", "left")
        ranked = rows.orderBy(F.desc("confidence"), F.collate("path", "en"), "path", "s_line", "s_col", "by").limit(limit + size if level > 1 else limit)
        got = ranked.collect()
        following = []
        for r in got:
            seen_sources.add(r["enclosing_id"])
            if r["enclosing_id"] is not None and r["enclosing_id"] not in seen_symbols and not r["seed"]:
                seen_symbols.add(r["enclosing_id"])
                following.append((r["pos"], r["rn"], r["enclosing_id"]))
        out += [(level, r["target"], r["source"] or TOP_LEVEL, r["enclosing_id"], r["sites"], r["confidence"], r["path"], r["s_line"], r["s_col"], r["provenance"]) for r in got[:left]]
        ids = [i for _, _, i in sorted(following)]
        size = len(ids)
        front = spark.createDataFrame(list(enumerate(ids)), "pos long, symbol_id long")
    schema = "depth int, target string, source string, enclosing_id long, sites long, confidence double, path string, s_line int, s_col int, provenance string"
    return spark.createDataFrame(out, schema)


def hierarchy(index: Index) -> DataFrame:
    """(sub, base) of precise inheritance edges."""
    o = index.occurrences.where(F.col("role").isin(*INHERITANCE_ROLES) & F.col("enclosing_id").isNotNull())
    return o.select(F.col("enclosing_id").alias("sub"), F.col("symbol_id").alias("base")).distinct()


def reach(edge: DataFrame, seeds: DataFrame, depth: int | None = None, a: str = "a", b: str = "b") -> DataFrame:
    """(seed, node, distance): nodes within ``depth`` steps of each seed, or any number, nearest distance, the seed itself at 0.

    Each level is written before the next one, so the plan stays short; it ends with the first level that finds nothing new.
    """
    step = cut(edge.select(F.col(a).alias("node"), F.col(b).alias("to")).distinct())
    known = seeds.select(F.col("seed"), F.col("seed").alias("node"), F.lit(0).alias("distance"))
    front = known
    for d in itertools.count(1) if depth is None else range(1, depth + 1):
        ahead = front.join(step, "node").select("seed", F.col("to").alias("node")).distinct()
        front = cut(ahead.join(known, ["seed", "node"], "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        known = known.union(front)
    return known


def supertype_chain(index: Index, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    return reach(hierarchy(index), seeds, depth, "sub", "base")


LOCAL_EDGES = 200_000


def strong_components(edge: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) of the components with a cycle, of a distinct edge table (a, b).

    Nodes without an edge in or out of the rest are trimmed; then each node takes the least node that reaches it, and of each such
    colour the nodes that reach the colour's own node are a component. Edges between colours or of found components go, and the
    rest is done again, until nothing is left. The state is written each round. Once no more than ``local_edges`` edges are left,
    which is counted, one depth-first pass on the driver does the rest: long chains would take a round each.
    """
    spark = edge.sparkSession
    loops = edge.where("a = b").select("a").distinct()
    left = cut(edge.where("a <> b").select("a", "b").distinct())
    parts: list[DataFrame] = []
    while True:
        size = left.count()
        if size <= local_edges:
            if size:
                pairs = [(r["a"], r["b"]) for r in left.collect()]
                parts.append(spark.createDataFrame(depth_first_components(pairs), "node long, component long"))
            break
        inner = cut(left.join(left.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(left.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
        if inner.count() < size:
            left = inner
            continue
        nodes = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
        colour = _spread(nodes.withColumn("c", F.col("node")), left)
        same = cut(
            left.join(colour.select(F.col("node").alias("a"), F.col("c").alias("ca")), "a").join(colour.select(F.col("node").alias("b"), F.col("c").alias("cb")), "b").where("ca = cb").select("a", "b", F.col("ca").alias("c"))
        )
        back = _reached(colour.where("node = c"), same)
        part = cut(back.select("node", F.col("c").alias("component")))
        parts.append(part)
        gone = part.select(F.col("node").alias("a"))
        left = cut(same.join(gone, "a", "left_anti").join(gone.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b"))
    alone = loops.select(F.col("a").alias("node"), F.col("a").alias("component"))
    if not parts:
        return alone
    found = functools.reduce(DataFrame.union, parts)
    sized = found.join(found.groupBy("component").count().where("count > 1"), "component").select("node", "component")
    return sized.union(alone.join(sized, "node", "left_anti"))


def depth_first_components(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, least node of its strongly connected component): finishing order forwards, then sweeps backwards in its reverse."""
    ahead: dict[int, list[int]] = {}
    behind: dict[int, list[int]] = {}
    for a, b in pairs:
        ahead.setdefault(a, []).append(b)
        behind.setdefault(b, []).append(a)
        ahead.setdefault(b, [])
        behind.setdefault(a, [])
    done, order = set(), []
    for start in ahead:
        if start in done:
            continue
        done.add(start)
        path = [(start, iter(ahead[start]))]
        while path:
            node, rest = path[-1]
            for n in rest:
                if n not in done:
                    done.add(n)
                    path.append((n, iter(ahead[n])))
                    break
            else:
                order.append(node)
                path.pop()
    out, seen = [], set()
    for start in reversed(order):
        if start in seen:
            continue
        seen.add(start)
        group, todo = [], [start]
        while todo:
            n = todo.pop()
            group.append(n)
            for m in behind[n]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        least = min(group)
        out += [(n, least) for n in group]
    return out


def _spread(state: DataFrame, edge: DataFrame) -> DataFrame:
    """The least colour that reaches each node, to a fixpoint."""
    state = cut(state)
    while True:
        into = state.join(edge, state["node"] == edge["a"]).select(F.col("b").alias("node"), "c")
        following = cut(state.union(into).groupBy("node").agg(F.min("c").alias("c")))
        if not following.join(state, ["node", "c"], "left_anti").limit(1).count():
            return following
        state = following


def _reached(roots: DataFrame, edge: DataFrame) -> DataFrame:
    """(node, c): nodes from which their colour's root can be reached along edges of that colour."""
    known = cut(roots.select("node", "c"))
    front = known
    while True:
        back = edge.join(front.select(F.col("node").alias("b"), "c"), ["b", "c"]).select(F.col("a").alias("node"), "c").distinct()
        front = cut(back.join(known, ["node", "c"], "left_anti"))
        if not front.limit(1).count():
            return known
        known = cut(known.union(front))


def cycles(component: DataFrame, names: DataFrame) -> DataFrame:
    """(size, files): sorted paths of each component, largest first. names: (node, path)."""
    rows = component.join(names, "node").groupBy("component").agg(F.array_sort(F.collect_list("path")).alias("files"))
    return rows.select(F.size("files").alias("size"), "files").orderBy(F.desc("size"), F.element_at("files", 1))
