"""Text lines for results: symbols, edges, explorations, cycles, matches, and what an empty result means."""

from __future__ import annotations

from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..schemas import Index
from . import graph, lookup

BODY_LINES = 12
STALE_MINUTES = 15


def one_line(text: Column, most: int = 80) -> Column:
    """White space runs as one space, clipped with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def symbol_line(cols: Callable[[str], Column] = F.col) -> Column:
    """[visibility] [static] [abstract] kind [Owner.]name  path:line [(exported)] [id: moniker]"""
    mods = F.concat_ws(" ", cols("visibility"), F.when(cols("is_static"), "static"), F.when(cols("is_abstract"), "abstract"))
    owner = F.when(F.coalesce(cols("owner_type"), F.lit("")) != "", F.concat(cols("owner_type"), F.lit("."))).otherwise("")
    return F.concat(
        F.when(mods != "", F.concat(mods, F.lit(" "))).otherwise(""), cols("kind"), F.lit(" "), owner, cols("name"), F.lit("  "), cols("path"), F.lit(":"), cols("s_line").cast("string"),
        F.when(cols("exported"), "  (exported)").otherwise(""), F.coalesce(F.concat(F.lit("  [id: "), cols("moniker"), F.lit("]")), F.lit("")),
    )


def depth_label(depth: Column) -> Column:
    return F.when(depth.isNull(), "").when(depth == 1, "direct ").otherwise(F.concat(F.lit("transitive (depth "), depth.cast("string"), F.lit(") ")))


def occurrence_line(label: Column, path: Column, line: Column, provenance: Column, confidence: Column, sites: Column | None = None, depth: Column | None = None) -> Column:
    """[direct |transitive (depth n) ]label  path:line  [provenance, score] [(sites: n)], the count where it is over one."""
    many = F.lit("") if sites is None else F.when(sites > 1, F.concat(F.lit("  (sites: "), sites.cast("string"), F.lit(")"))).otherwise("")
    near = F.lit("") if depth is None else depth_label(depth)
    return F.concat(near, label, F.lit("  "), path, F.lit(":"), line.cast("string"), F.lit("  ["), provenance, F.lit(", "), F.format_string("%.2f", confidence), F.lit("]"), many)


def call_line() -> Column:
    return occurrence_line(F.concat("source", F.lit(" → "), "target"), F.col("path"), F.col("s_line"), F.col("provenance"), F.col("confidence"))


def relation_line() -> Column:
    return occurrence_line(F.concat_ws(" ", "source", "role", "target"), F.col("path"), F.col("s_line"), F.col("provenance"), F.col("confidence"))


def cycle_line(size: Column, files: Column) -> Column:
    return F.concat(F.lit("cycle group ("), size.cast("string"), F.lit(" files): "), F.array_join(files, ", "))


def empty_message(reason: Column, name: Column, definitions: Column, sites: Column) -> Column:
    """What an empty result says, by reason."""
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    count, places = definitions.cast("string"), sites.cast("string")
    return (
        F.when(reason == "no-symbol", F.concat(F.lit("no symbol named "), quoted, F.lit(" (not indexed; sync if it is new)")))
        .when(reason == "no-edges", F.concat(quoted, F.lit(" is indexed ("), count, F.lit(" definition(s)) but has no matching edges")))
        .otherwise(F.concat(F.lit("No stored edges for "), quoted, F.lit(". It has "), count, F.lit(" declarations and "), places, F.lit(" parsed site(s); ambiguous name-only sites may have been suppressed.")))
    )


def fanout_message(name: Column, definitions: Column, sites: Column) -> Column:
    return F.concat(
        F.lit('"'), name, F.lit('" has '), definitions.cast("string"), F.lit(" declarations and "), sites.cast("string"),
        F.lit(" parsed site(s). Name-only resolution is capped at this fan-out, so additional ambiguous sites may be absent."),
    )


def diagnosis(index: Index, name: str) -> str:
    """The message for a name whose query came back empty."""
    facts = _facts(index, name)
    row = facts.select(empty_message(lookup.empty_reason(F.col("definitions"), F.col("bound"), F.col("sites")), F.lit(name), F.col("definitions"), F.col("sites")).alias("m")).first()
    return row["m"]


def warning(index: Index, name: str) -> str | None:
    """The message for a name whose fan-out may have cost it edges."""
    row = lookup.fanout_risk(_only(index, name)).select(fanout_message(F.col("name"), F.col("definitions"), F.col("sites")).alias("m")).first()
    return row and row["m"]


def _only(index: Index, name: str) -> Index:
    s = index.symbols.where(F.col("name") == name)
    o = index.occurrences.join(s.select(F.col("id").alias("symbol_id")), "symbol_id", "left_semi")
    return Index(index.files, s, o, index.refs.where(F.col("name") == name))


def _facts(index: Index, name: str) -> DataFrame:
    """One row: definitions, bound, sites of a name, zeros where it isn't known."""
    rows = lookup.per_name(_only(index, name)).select("definitions", "bound", "sites")
    return rows.agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in rows.columns])


def hierarchy_note(index: Index, name: str, incoming: bool) -> str | None:
    """What the hierarchy of a Go interface or type leaves out."""
    go = index.files.where("lang = 'go'").select(F.col("id").alias("file_id"))
    kinds = ["interface"] if incoming else ["interface", "type"]
    if index.symbols.where((F.col("name") == name) & F.col("kind").isin(kinds)).join(go, "file_id", "left_semi").isEmpty():
        return None
    if incoming:
        return "Go uses structural interface satisfaction, which this index does not compute. Results above contain only stored explicit hierarchy edges."
    return "Go type/interface embedding and structural satisfaction are not computed. Results above contain only stored explicit hierarchy edges."


def lines_of(rows: DataFrame, line: Column) -> list[str]:
    return [r["line"] for r in rows.select(line.alias("line")).collect()]


def edge_lines(index: Index, verb: str, name: str | None = None, moniker: str | None = None, limit: int = 20) -> list[str]:
    """callers, callees, refs, implementers or supertypes as lines, or why there are none."""
    made = {"callers": graph.callers, "callees": graph.callees, "refs": graph.references, "implementers": graph.implementers, "supertypes": graph.supertypes}[verb]
    relation = verb in ("implementers", "supertypes")
    rows = made(index, name, limit=limit) if relation else made(index, name, moniker, limit)
    out = lines_of(rows, relation_line() if relation or verb == "refs" else call_line())
    note = hierarchy_note(index, name, verb == "implementers") if relation else None
    if note:
        out.append(note)
    if out:
        if verb in ("callers", "refs") and name and (more := warning(index, name)):
            out.append(more)
        return out
    if name is not None:
        return [diagnosis(index, name)]
    own = lookup.definition_by_moniker(index, moniker).first()
    if own is None:
        return [f'no indexed declaration matches moniker "{moniker}"']
    return [f'no matching stored edges for moniker "{moniker}". Empty index output is not proof that no source relationship exists.']


def exploration(index: Index, budget: int, name: str | None = None, moniker: str | None = None, read: Callable[[str], str | None] = lambda path: None, rows: int = 15) -> list[str]:
    """A symbol's definition with the head of its body, callers, callees, hierarchy and impact, while the characters last. What a
    section leaves out is said. A name of several declarations gives these."""
    out: list[str] = []
    used = 0

    def add(line: str, forced: bool = False) -> bool:
        nonlocal used
        if not forced and used + len(line) + 1 > budget:
            return False
        out.append(line)
        used += len(line) + 1
        return True

    if name is not None:
        found = lookup.definitions(index, name, rows)
    else:
        found = lookup.definition_by_moniker(index, moniker)
    hits: list[Row] = found.select("moniker", "path", "s_line", "e_line", symbol_line().alias("line")).collect()
    if not hits:
        return [f'no symbol named "{name}"' if name is not None else f'no declaration matches moniker "{moniker}"']
    if len(hits) > 1:
        add(f"{len(hits)} candidates — pass a moniker to inspect one declaration:", True)
        for h in hits:
            if not add(h["line"]):
                break
        return out
    own = hits[0]
    add(own["line"], True)
    source = read(own["path"])
    if source is not None:
        first, last = own["s_line"] - 1, min(own["e_line"] - 1, own["s_line"] + BODY_LINES - 2)
        for line in source.split("\n")[first : last + 1]:
            if not add(line):
                break
        if last < own["e_line"] - 1:
            add(f"… (+{own['e_line'] - 1 - last} more body lines)")
    m = own["moniker"]
    totals = lookup.totals_by_symbol(index, graph.CALL_ROLES).join(index.symbols.where(F.col("moniker") == m).select(F.col("id").alias("symbol_id")), "symbol_id").first()
    near = {
        "callers": (graph.callers(index, moniker=m, limit=rows), call_line(), totals["callers"] if totals else 0),
        "callees": (graph.callees(index, moniker=m, limit=rows), call_line(), totals["callees"] if totals else 0),
        "implementers": (graph.incoming(index, graph.INHERITANCE_ROLES, None, m, rows), relation_line(), None),
        "supertypes": (graph.outgoing(index, graph.INHERITANCE_ROLES, None, m, rows), relation_line(), None),
    }
    for title, (edges, line, total) in near.items():
        lines = lines_of(edges, line)
        total = len(lines) if total is None else total
        if not lines or not add(f"{title} ({total}):"):
            continue
        shown = 0
        for text in lines:
            if not add(f"  {text}"):
                break
            shown += 1
        if total > shown:
            add(f"  +{total - shown} more {title}", True)
    depths = {r["depth"]: r["count"] for r in graph.impact(index, moniker=m, depth=2, limit=200).groupBy("depth").count().collect()}
    add(f"impact: direct {depths.get(1, 0)}, transitive(≤2) {depths.get(2, 0)}")
    return out


def age(minutes: float) -> str:
    """Whole minutes, hours or days."""
    n = int(minutes + 0.5)
    return f"{n}m" if n < 60 else f"{int(n / 60 + 0.5)}h" if n < 1440 else f"{int(n / 1440 + 0.5)}d"


def staleness(synced_at: str | None, now: datetime | None = None) -> str | None:
    """A hint where the last sync is more than STALE_MINUTES ago."""
    if not synced_at:
        return None
    minutes = ((now or datetime.now(UTC)) - datetime.fromisoformat(synced_at)).total_seconds() / 60
    return f"index synced {age(minutes)} ago — sync if results look stale" if minutes > STALE_MINUTES else None
