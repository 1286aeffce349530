"""From source files to the resolved code graph."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ident, paths
from ..operators import facts, lookup, resolve
from ..schemas import ECMASCRIPT, INHERITANCE_ROLES, PROVENANCE_RANK, Index
from ..sources import tree
from .lineage import cut

#: A front-end turns a text into facts, or None where it can't be parsed.
FrontEnd = Callable[[str], dict | None]
STEP = 1 << 20  # ids of a file's facts: file id times STEP plus their place in the file

_KINDS = {
    "symbols": "ord int, name string, kind string, range array<int>, name_range array<int>, owner_type string, visibility string, param_count int, variadic boolean, is_static boolean, is_abstract boolean, exported boolean, export_name string",
    "refs": "ord int, name string, role string, range array<int>, receiver string, arg_count int",
    "imports": "ord int, source string, kind string, imported_name string, local_name string, is_static boolean",
    "scopes": "idx int, parent_idx int, range array<int>",
    "scope_defs": "ord int, scope_idx int, name string, symbol int",
}


def front_ends() -> dict[str, FrontEnd]:
    from ..sources import brace_front, python_front, ruby_front

    ends: dict[str, FrontEnd] = {name: partial(brace_front.parse, name) for name in brace_front.LANGUAGES}
    return ends | {"python": python_front.parse, "ruby": ruby_front.parse}


_ARROW = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32())}
_FACTS = pa.struct([(t, pa.list_(pa.struct([(c.split(" ")[0], _ARROW[c.split(" ")[1]]) for c in k.split(", ")]))) for t, k in _KINDS.items()])


def facts_of(lang: str | None, content: str | None, ends: dict[str, FrontEnd]) -> dict | None:
    """Facts of one text, or None where no front-end takes it. Code that no pass gets through counts as unparsed."""
    if lang not in ends:
        return None
    try:
        found = ends[lang](content or "")
    except (RecursionError, IndexError):
        return None
    return found and {t: [{"ord": n} | x for n, x in enumerate(found[t])] for t in _KINDS}


def parse(files: DataFrame, ends: dict[str, FrontEnd] | None = None) -> DataFrame:
    """files (path, lang, content, ...) to one row a file with ``facts``, an array of structs per fact table; null where unparsed."""
    chosen = ends

    def run(batches):
        by_lang = front_ends() if chosen is None else chosen
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                rows = [facts_of(lang, content, by_lang) for lang, content in zip(part.column("lang").to_pylist(), part.column("content").to_pylist())]
                kept = part.drop_columns(["content"])
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rows, _FACTS)], names=[*kept.schema.names, "facts"])

    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields if f.name != "content")
    nested = ", ".join(f"{t}: array<struct<{', '.join(x.replace(' ', ': ', 1) for x in k.split(', '))}>>" for t, k in _KINDS.items())
    return files.mapInArrow(run, f"{plain}, facts struct<{nested}>")


def numbered(files: DataFrame, base: int = 0) -> DataFrame:
    """files with ``id``, dense from ``base`` in path order: a place within each range of a sort plus the sizes of those before."""
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    order = cut(files.select("path").orderBy("path").select("path", F.spark_partition_id().alias("part"), place.alias("place")))
    sizes = {r["part"]: r["count"] for r in order.groupBy("part").count().collect()}  # one number a task
    start, rows = base, []
    for part in sorted(sizes):
        rows.append((part, start))
        start += sizes[part]
    offsets = files.sparkSession.createDataFrame(rows, "part int, start long")
    ids = order.join(F.broadcast(offsets), "part").select("path", (F.col("start") + F.col("place")).alias("id"))
    return files.join(ids, "path")


def _flat(parsed: DataFrame, table: str) -> DataFrame:
    rows = parsed.select(F.col("id").alias("file_id"), "path", F.explode(f"facts.{table}").alias("x")).select("file_id", "path", "x.*")
    if "range" in rows.columns:
        rows = rows.select("*", *[F.col("range")[k].alias(c) for k, c in enumerate(facts.RANGE)]).drop("range")
    return rows


def tables(parsed: DataFrame) -> Index:
    """Clean fact tables of parsed files (id, path, lang, ..., facts). Occurrences are still missing."""
    fid = F.col("file_id") * STEP
    s = _flat(parsed, "symbols")
    s = s.select("*", *[F.col("name_range")[k].alias(c) for k, c in enumerate(facts.NAME_RANGE)]).drop("name_range").withColumn("id", fid + F.col("ord"))
    s = s.withColumn("moniker", ident.moniker(F.col("path"), F.col("owner_type"), F.col("name"), F.col("kind"), F.col("s_line"), F.col("s_col")))
    s = s.withColumn("exported", F.coalesce("exported", F.lit(False)))
    symbols = cut(facts.dedupe_symbols(s).drop("path"))
    r = _flat(parsed, "refs").withColumn("id", fid + F.col("ord")).drop("path", "ord")
    r = facts.dedupe_refs(facts.drop_definition_refs(r, symbols))
    inherits = F.col("role").isin(*INHERITANCE_ROLES)
    refs = cut(facts.enclosing(facts.merge_relations(r.where(~inherits), r.where(inherits)), symbols))
    imports = cut(_flat(parsed, "imports").withColumn("id", fid + F.col("ord")).drop("path", "ord"))
    scopes = cut(_flat(parsed, "scopes").drop("path"))
    monikers = symbols.select("file_id", F.col("ord").alias("symbol"), F.col("moniker").alias("symbol_moniker"))
    defs = cut(_flat(parsed, "scope_defs").withColumn("id", fid + F.col("ord")).drop("path", "ord").join(monikers, ["file_id", "symbol"], "left").drop("symbol"))
    return Index(parsed.drop("facts"), symbols.drop("ord"), None, refs, imports, scopes, defs)


@dataclass(frozen=True)
class Layout:
    """A project's path aliases (prefix, wildcard, targets), base folder, and Go module name."""

    aliases: tuple[tuple[str, bool, tuple[str, ...]], ...] = ()
    base_url: str | None = None
    go_module: str | None = None

    @staticmethod
    def of(tsconfig: str | None = None, go_mod: str | None = None) -> Layout:
        """From the two files' texts; comments and trailing commas are allowed, a broken file counts as absent."""
        bare = re.sub(r",(\s*[}\]])", r"\1", re.sub(r"(?m)/\*.*?\*/|(?<![:\"'])//[^\n]*", "", tsconfig or "", flags=re.S))
        try:
            options = json.loads(bare or "{}").get("compilerOptions") or {}
        except (ValueError, AttributeError):
            options = {}
        aliases = tuple((k.removesuffix("*"), k.endswith("*"), tuple(v)) for k, v in (options.get("paths") or {}).items())
        module = re.search(r"(?m)^\s*module\s+(\S+)", go_mod or "")
        return Layout(aliases, options.get("baseUrl"), module[1] if module else None)


    @staticmethod
    def from_json(text: str | None) -> Layout:
        """What ``asdict`` and JSON made of one."""
        got = json.loads(text or "{}")
        return Layout(tuple((p, w, tuple(t)) for p, w, t in got.get("aliases", ())), got.get("base_url"), got.get("go_module"))


def import_edges(index: Index, layout: Layout = Layout()) -> DataFrame:
    """(a, b): files of the ECMAScript languages and the files that they import or re-export from."""
    own = index.files.where(F.col("lang").isin(*ECMASCRIPT)).select(F.col("id").alias("file_id"), "path")
    i = index.imports.join(own, "file_id")
    module = resolve.first_existing(resolve.module_candidates(i.select("id", "path", "source"), list(layout.aliases), layout.base_url), index.files)
    return i.select("id", F.col("file_id").alias("a")).join(module.select("id", F.col("file_id").alias("b")), "id").select("a", "b").distinct()


def imported(refs: DataFrame, index: Index, layout: Layout) -> DataFrame:
    """Targets through imports, language by language."""
    langs = index.files.select(F.col("id").alias("file_id"), "lang", "path")
    of = lambda d, *names: d.join(langs.where(F.col("lang").isin(*names)).select("file_id"), "file_id", "left_semi")
    script = Index(index.files, index.symbols, None, None, of(index.imports, *ECMASCRIPT))
    at = script.imports.join(langs, "file_id").select("id", "path", "source")
    module = cut(resolve.first_existing(resolve.module_candidates(at, list(layout.aliases), layout.base_url), index.files))
    out = resolve.bind_ecmascript(of(refs, *ECMASCRIPT), script, module).union(resolve.bind_python(of(refs, "python"), index))
    return out.union(resolve.bind_go(of(refs, "go"), index, layout.go_module)).union(resolve.bind_java(of(refs, "java"), index))


@dataclass(frozen=True)
class Provider:
    """A resolver of a tier over the built-in ones (3 and up): fn(refs, index) gives (ref_id, symbol_id, resolution, base).

    extensions: of the files whose references it is asked about; None for all.
    """

    tier: int
    fn: Callable[[DataFrame, Index], DataFrame]
    extensions: tuple[str, ...] | None = None

    def asked(self, refs: DataFrame, index: Index) -> DataFrame:
        if self.extensions is None:
            return refs
        own = index.files.where(paths.extension(F.col("path")).isin(*self.extensions)).select(F.col("id").alias("file_id"))
        return refs.join(own, "file_id", "left_semi")


def typed(facts_table: DataFrame) -> Provider:
    """A provider over what a compiler knows: rows (path, line, col, def_path, def_line, def_col) from a reference's start to a
    place in its definition. The smallest symbol there is the target, with score 1."""

    def fn(refs: DataFrame, index: Index) -> DataFrame:
        f = index.files.select(F.col("id").alias("file_id"), "path")
        known = facts_table.join(f, "path").select("file_id", F.col("line").alias("s_line"), F.col("col").alias("s_col"), "def_path", "def_line", "def_col")
        used = refs.select(F.col("id").alias("ref_id"), "file_id", "s_line", "s_col").join(known, ["file_id", "s_line", "s_col"])
        places = used.join(f.select(F.col("file_id").alias("def_file"), F.col("path").alias("def_path")), "def_path")
        places = places.select("ref_id", F.col("def_file").alias("file_id"), F.col("def_line").alias("line"), F.col("def_col").alias("col"))
        return lookup.symbol_at(index, places).select("ref_id", "symbol_id", F.lit("typed").alias("resolution"), F.lit(1.0).alias("base"))

    return Provider(3, fn, tuple(e for lang in ECMASCRIPT for e in paths.LANGUAGES[lang]))


def targets(refs: DataFrame, index: Index, layout: Layout, providers: tuple[Provider, ...] = ()) -> DataFrame:
    """Scored targets (ref_id, symbol_id, resolution, confidence) of references, by the cascade of tiers."""
    first = [p.fn(p.asked(refs, index), index) for p in sorted(providers, key=lambda p: -p.tier)]
    ids = index.symbols.select("moniker", "id")
    bound = resolve.scope_binding(refs, index.scopes, index.scope_defs)
    scoped = bound.join(ids, "moniker", "left").select("ref_id", F.col("id").alias("symbol_id"), F.lit("scoped").alias("resolution"), F.lit(1.0).alias("base"))
    through = imported(refs, index, layout)
    named = resolve.by_name(refs.where("receiver IS NULL OR receiver NOT IN ('this', 'self')"), index)
    return resolve.weight_targets(resolve.cascade([*first, scoped, through, resolve.same_file(refs, index), named])).drop("base")


def resolved(index: Index, layout: Layout = Layout(), providers: tuple[Provider, ...] = (), scope: DataFrame | None = None) -> Index:
    """The index with its edges: inheritance first, as members inherited through it serve the rest.

    scope: (file_id) of the files whose other references are resolved; without it, of all files.
    """
    inherits = F.col("role").isin(*INHERITANCE_ROLES)
    up = cut(targets(index.refs.where(inherits), index, layout, providers))
    precise = up.where(F.col("resolution") != "name").join(index.refs.select(F.col("id").alias("ref_id"), "enclosing_id"), "ref_id")
    bases = cut(precise.where("enclosing_id IS NOT NULL").select(F.col("enclosing_id").alias("sub"), F.col("symbol_id").alias("base")).distinct())
    asked = index.refs.where(~inherits) if scope is None else index.refs.where(~inherits).join(scope, "file_id", "left_semi")
    rest = cut(targets(asked, index, layout, providers))
    own = asked.where(F.col("receiver").isin("this", "self")).join(rest.where(F.col("resolution") != "name"), F.col("id") == F.col("ref_id"), "left_anti")
    around = index.symbols.select(F.col("id").alias("enclosing_id"), "owner_type").where("owner_type IS NOT NULL")
    own = own.join(around, "enclosing_id").join(resolve.owner_class(index), ["file_id", "owner_type"])
    inherited = resolve.inherited_members(own.select("id", "owner_id", "name"), index, bases).withColumn("resolution", F.lit("inherited"))
    found = up.unionByName(rest.join(inherited.select("ref_id"), "ref_id", "left_anti")).unionByName(inherited)
    r = index.refs.select(F.col("id").alias("ref_id"), "file_id", *facts.RANGE, "role", "enclosing_id")
    named = F.col("resolution").isin(*PROVENANCE_RANK)
    edges = found.join(r, "ref_id").withColumn("provenance", F.when(named, F.col("resolution")).otherwise("syntactic"))
    edges = edges.withColumn("id", F.xxhash64("ref_id", "symbol_id"))
    return replace(index, occurrences=cut(edges.select("id", "symbol_id", "file_id", *facts.RANGE, "role", "enclosing_id", "provenance", "confidence")))


def prepared(files: DataFrame) -> DataFrame:
    """files (path, content [, size, mtime_ms, lang]) that may be indexed, with lang and hash."""
    f = files if "size" in files.columns else files.withColumn("size", F.octet_length("content").cast("long"))
    f = f if "lang" in files.columns else tree.indexable(f)
    return tree.not_generated(f.withColumn("hash", F.sha2("content", 256)))


def build(files: DataFrame, ends: dict[str, FrontEnd] | None = None, layout: Layout = Layout(), providers: tuple[Provider, ...] = ()) -> Index:
    """The whole index of files (path, content [, size, mtime_ms, lang])."""
    parsed = cut(parse(prepared(files), ends)).where("facts IS NOT NULL")
    return resolved(tables(cut(numbered(parsed))), layout, providers)


def layout_of(root: str) -> Layout:
    """Of the tsconfig.json and go.mod at the root of a tree."""
    return Layout.of(tree.read_text(root, "tsconfig.json"), tree.read_text(root, "go.mod"))


def build_tree(spark: SparkSession, root: str, ignore: dict[str, str] | None = None) -> Index:
    """The whole index of a folder of source files, by its ignore files and its layout."""
    chosen = tree.choose(tree.list_tree(spark, root), ignore)
    return build(tree.read_files(chosen, root), layout=layout_of(root))
