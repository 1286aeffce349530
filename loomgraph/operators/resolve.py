"""Reference resolution: tiers of joins, first hit wins, then weighting."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..plans.lineage import cut
from ..schemas import CALL_ROLES, CLASS_KINDS, ECMASCRIPT, FANOUT_CAP, INHERITANCE_ROLES, PRECISE, PRECISE_FLOOR, Index
from .facts import RANGE
from .graph import reach

MODULE_EXTENSIONS = (".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mts", ".cts", ".mjs")


def distance_confidence(d: Column) -> Column:
    return F.greatest(F.lit(0.5), 0.85 - 0.1 * (d - 1))


def arity_base(lang: Column, args: Column, params: Column, variadic: Column) -> Column:
    """Score of a name-only target: halved where a call passes more arguments than the declaration takes."""
    bad = ~lang.isin(*ECMASCRIPT) & args.isNotNull() & params.isNotNull() & (args > params) & ~F.coalesce(variadic, F.lit(False))
    return F.when(bad, 0.25).otherwise(0.5)


def weight_targets(targets: DataFrame) -> DataFrame:
    """Rows (ref_id, symbol_id, resolution, base) to scored ones.

    A single target of at least PRECISE_FLOOR stays as it is. Else precise targets oust name-only ones and share their score; more than
    FANOUT_CAP name-only targets are dropped, fewer share it.
    """
    precise = F.col("resolution").isin(*PRECISE)
    per = Window.partitionBy("ref_id")
    t = targets.withColumn("_p", F.sum(precise.cast("int")).over(per)).withColumn("_n", F.count("*").over(per))
    t = t.where(precise | ((F.col("_p") == 0) & (F.col("_n") <= FANOUT_CAP)))
    share = F.when(F.col("_p") > 0, F.col("_p")).otherwise(F.col("_n"))
    return t.withColumn("confidence", F.when((F.col("_n") == 1) & (F.col("base") >= PRECISE_FLOOR), F.col("base")).otherwise(F.col("base") / share)).drop("_p", "_n")


def weight_by_key(uses: DataFrame, targets: DataFrame, key: str) -> DataFrame:
    """Scored rows where all references of a key have the same targets. uses: (ref_id, key); targets: (key, symbol_id, resolution, base).
    Each key's targets are weighted once, and only those that stay meet its references: the products are never shuffled."""
    once = weight_targets(targets.withColumnRenamed(key, "ref_id")).withColumnRenamed("ref_id", key)
    return uses.join(once, key).drop(key)


def cascade(tiers: list[DataFrame]) -> DataFrame:
    """Of tables (ref_id, ...) from the highest tier down: each reference's rows from the first that has any. A row with a null
    symbol_id (bound to a local) ends the search and gives nothing."""
    every = None
    for k, t in enumerate(tiers):
        t = t.withColumn("_tier", F.lit(k))
        every = t if every is None else every.unionByName(t)
    first = F.min("_tier").over(Window.partitionBy("ref_id"))
    return every.withColumn("_first", first).where("_tier = _first AND symbol_id IS NOT NULL").drop("_tier", "_first")


def by_name(refs: DataFrame, index: Index) -> DataFrame:
    """Name-only targets in compatible languages; nothing at all from the ninth candidate on.

    Names beyond the cap within a language family can't give a target, so they go before the join: no name multiplies.
    """
    s = index.symbols.join(index.files.select(F.col("id").alias("file_id"), F.col("lang").alias("s_lang")), "file_id")
    s = s.select("name", F.col("id").alias("symbol_id"), paths.family(F.col("s_lang")).alias("family"), "param_count", "variadic")
    few = s.groupBy("name", "family").count().where(F.col("count") <= FANOUT_CAP).select("name", "family")
    r = refs.join(index.files.select(F.col("id").alias("file_id"), "lang"), "file_id").withColumn("family", paths.family(F.col("lang")))
    joined = r.join(s.join(few, ["name", "family"], "left_semi"), ["name", "family"])
    return joined.select(F.col("id").alias("ref_id"), "symbol_id", F.lit("name").alias("resolution"), arity_base(F.col("lang"), F.col("arg_count"), F.col("param_count"), F.col("variadic")).alias("base"))


def same_file(refs: DataFrame, index: Index) -> DataFrame:
    """Bare names: symbols of the file. this/self: members of the enclosing symbol's owner in the file."""
    s = index.symbols.select("file_id", "name", F.col("id").alias("symbol_id"), "owner_type")
    bare = refs.where("receiver IS NULL").join(s, ["file_id", "name"])
    own = refs.where(F.col("receiver").isin("this", "self")).join(index.symbols.select(F.col("id").alias("enclosing_id"), F.col("owner_type").alias("owner")), "enclosing_id")
    member = own.join(s, ["file_id", "name"]).where("owner_type = owner")
    pick = [F.col("id").alias("ref_id"), "symbol_id", F.lit("same-file").alias("resolution"), F.lit(1.0).alias("base")]
    return bare.select(*pick).union(member.select(*pick))


def scope_ancestors(scopes: DataFrame) -> DataFrame:
    """(file_id, idx, ancestor, distance): each scope's chain of parents, itself first. A parent's number is less than its own."""
    parent = scopes.where("parent_idx < idx").select("file_id", F.col("idx").alias("ancestor"), F.col("parent_idx").alias("up"))
    front = scopes.select("file_id", "idx", F.col("idx").alias("ancestor"), F.lit(0).alias("distance"))
    out = front
    for d in itertools.count(1):
        front = cut(front.join(parent, ["file_id", "ancestor"]).select("file_id", "idx", F.col("up").alias("ancestor"), F.lit(d).alias("distance")))
        if front.isEmpty():
            break
        out = out.union(front)
    return out


def scope_of(refs: DataFrame, scopes: DataFrame) -> DataFrame:
    """(ref_id, file_id, name, idx): the innermost scope that contains each reference's start; the file's root (0) where none does."""
    s = scopes.select("file_id", "idx", *[F.col(c).alias("_" + c) for c in RANGE])
    at = lambda p, q: (F.col(p + "line") < F.col(q + "line")) | ((F.col(p + "line") == F.col(q + "line")) & (F.col(p + "col") <= F.col(q + "col")))
    size = (F.col("_e_line") - F.col("_s_line")).cast("long") * 10_000 + F.col("_e_col") - F.col("_s_col")
    inner = refs.join(s, "file_id").where(at("_s_", "s_") & at("s_", "_e_")).groupBy("id").agg(F.min(F.struct(size.alias("z"), (-F.col("idx")).alias("i"))).alias("m"))
    return refs.join(inner, "id", "left").select(F.col("id").alias("ref_id"), "file_id", "name", F.coalesce(-F.col("m.i"), F.lit(0)).alias("idx"))


def scope_binding(refs: DataFrame, scopes: DataFrame, scope_defs: DataFrame) -> DataFrame:
    """(ref_id, moniker): what each bare name is bound to in the nearest scope that defines it; a null moniker is a local."""
    placed = scope_of(refs.where("receiver IS NULL"), scopes)
    chain = placed.join(scope_ancestors(scopes), ["file_id", "idx"])
    defs = scope_defs.select("file_id", F.col("scope_idx").alias("ancestor"), "name", F.col("id").alias("def_id"), "symbol_moniker")
    found = chain.join(defs, ["file_id", "ancestor", "name"])
    best = F.min(F.struct("distance", F.col("symbol_moniker").isNull().alias("local"), "def_id", "symbol_moniker")).alias("m")
    return found.groupBy("ref_id").agg(best).select("ref_id", F.col("m.symbol_moniker").alias("moniker"))


def module_candidates(imports: DataFrame, layout: list[tuple[str, bool, list[str]]] = (), base_url: str | None = None) -> DataFrame:
    """(id, ord, candidate): paths that an ECMAScript import may mean, in order. imports: (id, path, source).

    layout: (prefix, wildcard, targets) aliases, a short configured list; base_url holds where no alias fits.
    """
    relative = paths.normalised(F.concat(paths.dirname(F.col("path")), F.lit("/"), F.col("source")))
    none = F.array().cast("array<string>")
    aliased = none
    for prefix, wild, targets in layout:
        fits = F.startswith("source", F.lit(prefix)) if wild else F.col("source") == prefix
        rest = F.substring("source", len(prefix) + 1, 1 << 20)
        made = F.array(*[paths.normalised(F.replace(F.lit(t), F.lit("*"), rest)) for t in targets])
        aliased = F.concat(aliased, F.when(fits, made).otherwise(none))
    plain = F.array(paths.normalised(F.concat(F.lit(base_url + "/"), F.col("source")))) if base_url is not None else none
    stems = F.when(F.startswith("source", F.lit(".")), F.array(relative)).when(F.size(aliased) > 0, aliased).otherwise(plain)
    bare = F.regexp_replace("raw", r"\.[cm]?[jt]sx?$", "")
    tries = F.array(F.col("raw"), *[c for e in MODULE_EXTENSIONS for c in (F.concat(bare, F.lit(e)), F.concat("raw", F.lit(e)), F.concat("raw", F.lit("/index" + e)))])
    rows = imports.select("id", F.posexplode(stems).alias("stem_ord", "raw"))
    return rows.select("id", "stem_ord", F.posexplode(tries).alias("pos", "candidate")).select("id", (F.col("stem_ord") * 100 + F.col("pos")).alias("ord"), "candidate")


def first_existing(candidates: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file_id): the first candidate that is a file."""
    hit = candidates.join(files.select(F.col("path").alias("candidate"), F.col("id").alias("file_id")), "candidate")
    return hit.groupBy("id").agg(F.min_by("file_id", "ord").alias("file_id"))


def python_candidates(imports: DataFrame) -> DataFrame:
    """(id, ord, candidate): module files of Python imports (id, path, source), exact paths."""
    dots = F.length(F.regexp_extract("source", r"^\.*", 0))
    rest = F.regexp_replace(F.regexp_replace("source", r"^\.+", ""), r"\.", "/")
    segments = F.split(F.col("path"), "/")
    base = F.array_join(F.slice(segments, F.lit(1), F.greatest(F.size(segments) - F.greatest(dots, F.lit(1)), F.lit(0))), "/")
    at = F.when(dots > 0, F.when(base == "", rest).when(rest == "", base).otherwise(F.concat_ws("/", base, rest))).otherwise(rest)
    init = F.when(at == "", F.lit("__init__.py")).otherwise(F.concat(at, F.lit("/__init__.py")))
    tries = F.when(rest == "", F.array(init)).otherwise(F.array(F.concat(at, F.lit(".py")), init))
    return imports.select("id", F.posexplode(tries).alias("ord", "candidate"))


def python_modules(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(id, file_id): every file that a Python import names; where no exact path exists, files whose path ends with it."""
    tries = python_candidates(imports)
    exact = tries.join(files.select(F.col("path").alias("candidate"), F.col("id").alias("file_id")), "candidate").select("id", "file_id")
    rest = tries.join(exact, "id", "left_anti").withColumn("base", paths.basename(F.col("candidate")))
    tail = files.select(F.col("id").alias("file_id"), "path", paths.basename(F.col("path")).alias("base"))
    loose = rest.join(tail, "base").where(F.endswith("path", F.concat(F.lit("/"), F.col("candidate")))).select("id", "file_id")
    return exact.union(loose).distinct()


def bind_python(refs: DataFrame, index: Index) -> DataFrame:
    """From-imports of a name, and members of an imported module; score 0.9."""
    files = index.files
    imports = index.imports.join(files.where("lang = 'python'").select(F.col("id").alias("file_id"), "path"), "file_id")
    first = Window.partitionBy("ref_id").orderBy("import_id")
    i = imports.select(F.col("id").alias("import_id"), "file_id", "source", "kind", "imported_name", "local_name", "path")
    r = refs.select(F.col("id").alias("ref_id"), "file_id", "name", "receiver")
    named = r.where("receiver IS NULL").join(i.where("kind = 'named'"), "file_id").where("local_name = name").select("ref_id", "import_id", F.col("imported_name").alias("wanted"), "source", "path")
    space = r.where("receiver IS NOT NULL").join(i.where("kind = 'namespace'"), "file_id").where("local_name = receiver OR source = receiver").select("ref_id", "import_id", F.col("name").alias("wanted"), "source", "path")
    dotted = F.when(F.endswith("source", F.lit(".")), F.concat("source", "imported_name")).otherwise(F.concat_ws(".", "source", "imported_name"))
    sub = r.where("receiver IS NOT NULL").join(i.where("kind = 'named'"), "file_id").where("local_name = receiver").select("ref_id", "import_id", F.col("name").alias("wanted"), dotted.alias("source"), "path")
    sub = sub.join(space, "ref_id", "left_anti")
    uses = named.union(space).union(sub).withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r")
    target = python_modules(uses.select(F.col("ref_id").alias("id"), "path", "source"), files).withColumnRenamed("id", "ref_id")
    s = index.symbols.select("file_id", F.col("name").alias("wanted"), F.col("id").alias("symbol_id"))
    return uses.join(target, "ref_id").join(s, ["file_id", "wanted"]).select("ref_id", "symbol_id", F.lit("import").alias("resolution"), F.lit(0.9).alias("base"))


def inherited_members(refs: DataFrame, index: Index, bases: DataFrame) -> DataFrame:
    """(ref_id, symbol_id, confidence): members that this/self references find up the supertype chain, nearest level only.

    refs: with ``owner_id``, the class symbol of the reference. bases: (sub, base) symbol ids. Declarations without a body give way to
    bodies and score at most 0.5 alone; several share the score.
    """
    up = reach(bases, refs.select(F.col("owner_id").alias("seed")).distinct(), None, "sub", "base").where("distance > 0")
    base = index.symbols.select(F.col("id").alias("node"), F.col("file_id").alias("f"), F.col("name").alias("owner"), F.col("kind").alias("base_kind"))
    member = index.symbols.select(F.col("file_id").alias("f"), F.col("owner_type").alias("owner"), "name", F.col("id").alias("symbol_id"), "is_abstract", "is_static")
    found = refs.select(F.col("id").alias("ref_id"), "owner_id", "name").join(up, F.col("owner_id") == F.col("seed")).join(base, "node").join(member, ["f", "owner", "name"])
    found = found.where(~F.coalesce("is_static", F.lit(False))).withColumn("bare", F.coalesce("is_abstract", F.lit(False)) | (F.col("base_kind") == "interface"))
    per = Window.partitionBy("ref_id")
    found = found.withColumn("solid", F.sum((~F.col("bare")).cast("int")).over(per)).where("solid = 0 OR NOT bare")
    near = found.withColumn("nearest", F.min("distance").over(per)).where("distance = nearest").dropDuplicates(["ref_id", "symbol_id"])
    score = distance_confidence(F.col("distance"))
    score = F.when(F.col("solid") == 0, F.least(score, F.lit(0.5))).otherwise(score)
    return near.select("ref_id", "symbol_id", (score / F.count("*").over(per)).alias("confidence"))


def insert_occurrences(records: DataFrame, index: Index) -> DataFrame:
    """Records by moniker as edges by id: unknown files and targets go, an unknown enclosing symbol is null. Of symbols that share a
    moniker the last one counts, so a record stays one edge."""
    ids = index.symbols.groupBy("moniker").agg(F.max("id").alias("id"))
    target = ids.select(F.col("moniker").alias("target_moniker"), F.col("id").alias("symbol_id"))
    around = ids.select(F.col("moniker").alias("enclosing_moniker"), F.col("id").alias("enclosing_id"))
    known = records.join(index.files.select(F.col("id").alias("file_id")), "file_id", "left_semi")
    return known.join(target, "target_moniker").join(around, "enclosing_moniker", "left").drop("target_moniker", "enclosing_moniker")


def drop_shadowed(occurrences: DataFrame) -> DataFrame:
    """Call and reference edges at a place that an ingested index covers go; inheritance edges stay."""
    scip = occurrences.where("provenance = 'scip'").select("file_id", *RANGE).distinct()
    mine = occurrences.where((F.col("provenance") != "scip") & F.col("role").isin(*CALL_ROLES)).join(scip, ["file_id", *RANGE], "left_anti")
    return mine.unionByName(occurrences.where((F.col("provenance") == "scip") | ~F.col("role").isin(*CALL_ROLES)))


def owner_class(index: Index) -> DataFrame:
    """(file_id, owner_type, owner_id): the class that an owner name means in its file, class-like kinds first."""
    o = Window.partitionBy("file_id", "name").orderBy(F.col("kind").isin(*CLASS_KINDS).cast("int").desc(), "id")
    s = index.symbols.withColumn("_r", F.row_number().over(o)).where("_r = 1")
    return s.select("file_id", F.col("name").alias("owner_type"), F.col("id").alias("owner_id"))


def follow_exports(uses: DataFrame, index: Index, module: DataFrame) -> DataFrame:
    """(use_id, symbol_id): what a name exported by a file is, re-exports followed until a file has it, each (file, name) once a use.

    uses: (use_id, file_id, name). module: (id, file_id), the target file of each import.
    """
    export_name = F.col("export_name") if "export_name" in index.symbols.columns else F.lit(None).cast("string")
    s = index.symbols.where("exported").select("file_id", "name", export_name.alias("export_name"), F.col("id").alias("symbol_id"))
    exports = s.select("file_id", "name", "symbol_id").union(s.where("export_name IS NOT NULL").select("file_id", "export_name", "symbol_id")).distinct()
    step = index.imports.select("id", "file_id", "kind", "local_name", "imported_name").join(module.withColumnRenamed("file_id", "to_file"), "id")
    named = step.where("kind = 'reexport'").select("file_id", F.col("local_name").alias("name"), "to_file", F.col("imported_name").alias("to_name")).distinct()
    star = step.where("kind = 'reexport-star'").select("file_id", "to_file").distinct()
    front, seen, out = uses.select("use_id", "file_id", "name").distinct(), None, None
    while True:
        front = cut(front if seen is None else front.join(seen, ["use_id", "file_id", "name"], "left_anti"))
        if front.isEmpty():
            break
        seen = front if seen is None else seen.union(front)
        hit = front.join(exports, ["file_id", "name"])
        out = hit.select("use_id", "symbol_id") if out is None else out.union(hit.select("use_id", "symbol_id"))
        rest = front.join(hit.select("use_id", "file_id", "name").distinct(), ["use_id", "file_id", "name"], "left_anti")
        a = rest.join(named, ["file_id", "name"]).select("use_id", F.col("to_file").alias("file_id"), F.col("to_name").alias("name"))
        b = rest.join(star, "file_id").select("use_id", F.col("to_file").alias("file_id"), "name")
        front = a.union(b).distinct()
    return uses.sparkSession.createDataFrame([], "use_id long, symbol_id long") if out is None else out.distinct()


def bind_ecmascript(refs: DataFrame, index: Index, module: DataFrame) -> DataFrame:
    """Named and default imports of a bare name, and members of a namespace import; score 0.9. module: (id, file_id) of the imports."""
    i = index.imports.join(module.select("id", F.col("file_id").alias("to_file")), "id").select("file_id", "kind", "local_name", "imported_name", "to_file")
    r = refs.select(F.col("id").alias("ref_id"), "file_id", "name", "receiver")
    bare = r.where("receiver IS NULL").join(i.where("kind IN ('named', 'default')"), "file_id").where("local_name = name")
    space = r.where("receiver IS NOT NULL").join(i.where("kind = 'namespace'"), "file_id").where("local_name = receiver")
    uses = bare.select(F.col("ref_id").alias("use_id"), F.col("to_file").alias("file_id"), F.coalesce("imported_name", "name").alias("name"))
    uses = uses.union(space.select("ref_id", "to_file", "name"))
    return follow_exports(uses, index, module).select(F.col("use_id").alias("ref_id"), "symbol_id", F.lit("import").alias("resolution"), F.lit(0.9).alias("base"))


def package_dirs(imports: DataFrame, files: DataFrame, go_module: str | None = None) -> DataFrame:
    """(id, dir): the directory of each Go import (id, source): behind the module's own prefix, else the longest suffix that is one."""
    dirs = files.select(paths.dirname(F.col("path")).alias("dir")).distinct()
    parts = F.split(F.col("source"), "/")
    own = F.lit(None).cast("string")
    if go_module is not None:
        own = F.when(F.col("source") == go_module, "").when(F.startswith("source", F.lit(go_module + "/")), F.substring("source", len(go_module) + 2, 1 << 20))
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))
    tries = imports.select("id", F.posexplode(F.concat(F.array(own), suffixes)).alias("ord", "dir")).where("dir IS NOT NULL")
    return tries.join(dirs, "dir").groupBy("id").agg(F.min_by("dir", "ord").alias("dir"))


def bind_go(refs: DataFrame, index: Index, go_module: str | None = None) -> DataFrame:
    """Exported symbols of the receiver's package (0.9); bare names: symbols of other files in the directory (0.85), else dot imports."""
    go = index.files.where("lang = 'go'").select(F.col("id").alias("file_id"), "path", paths.dirname(F.col("path")).alias("dir"))
    i = index.imports.join(go.select("file_id"), "file_id", "left_semi").select("id", "file_id", "kind", "source", "local_name")
    target = i.join(package_dirs(i, go, go_module), "id")
    s = index.symbols.join(go.select("file_id", "dir"), "file_id").select(F.col("file_id").alias("s_file"), "dir", "name", F.col("id").alias("symbol_id"), "exported")
    r = refs.join(go.select("file_id", F.col("dir").alias("own_dir")), "file_id").select(F.col("id").alias("ref_id"), "file_id", "own_dir", "name", "receiver")
    first = Window.partitionBy("ref_id").orderBy("id")
    used = r.where("receiver IS NOT NULL").join(target.where("kind = 'namespace'"), "file_id").where("local_name = receiver").withColumn("_r", F.row_number().over(first)).where("_r = 1")
    member = used.join(s.where("exported"), ["dir", "name"])
    sibling = r.where("receiver IS NULL").join(s.withColumnRenamed("dir", "own_dir"), ["own_dir", "name"]).where("s_file <> file_id")
    dotted = r.where("receiver IS NULL").join(target.where("kind = 'wildcard'"), "file_id").join(s.where("exported"), ["dir", "name"]).join(sibling.select("ref_id"), "ref_id", "left_anti")
    pick = lambda d, kind, base: d.select("ref_id", "symbol_id", F.lit(kind).alias("resolution"), F.lit(base).alias("base"))
    return pick(member, "import", 0.9).union(pick(sibling, "package", 0.85)).union(pick(dotted, "import", 0.9)).distinct()


def bind_java(refs: DataFrame, index: Index) -> DataFrame:
    """Class imports, wildcards, static imports (0.9) and the own package (0.85), in that order; the first that has the name wins.

    A receiver that a plain import names is that class and nothing else.
    """
    java = index.files.where("lang = 'java'").select(F.col("id").alias("file_id"), "path", paths.dirname(F.col("path")).alias("dir"))
    i = index.imports.join(java.select("file_id"), "file_id", "left_semi").select("id", "file_id", "kind", F.nullif("source", F.lit("")).alias("source"), "local_name", "imported_name", F.coalesce("is_static", F.lit(False)).alias("static"))
    r = refs.join(java.select("file_id", "dir"), "file_id").select(F.col("id").alias("ref_id"), "file_id", "dir", "name", "receiver")
    wide, member = F.col("kind") == "wildcard", F.col("receiver").isNotNull()
    j = r.join(i, "file_id")
    named_class = member & ~wide & ~F.col("static") & (F.col("local_name") == F.col("receiver"))
    order = (
        F.when(named_class, 0)
        .when(member & wide, 1)
        .when(~member & F.col("static") & ~wide & (F.col("local_name") == F.col("name")), 0)
        .when(~member & F.col("static") & wide, 1)
        .when(~member & ~F.col("static") & ~wide & (F.col("local_name") == F.col("name")), 2)
        .when(~member & ~F.col("static") & wide, 3)
    )
    inner = F.when(wide & ~F.col("static"), F.coalesce("receiver", "name")).when(wide & member, F.col("receiver")).when(~wide & ~F.col("static"), F.col("imported_name"))
    j = j.withColumn("prio", order).where("prio IS NOT NULL").withColumn("fqn", F.concat_ws(".", "source", inner))
    first = Window.partitionBy("ref_id", "prio").orderBy("id")
    j = j.withColumn("_r", F.row_number().over(first)).where(~member | (F.col("_r") == 1))
    fixed = j.where(member & (F.col("prio") == 0)).select("ref_id").distinct()
    j = j.where(~member | (F.col("prio") == 0)).unionByName(j.where(member & (F.col("prio") > 0)).join(fixed, "ref_id", "left_anti"))
    tries = j.select("ref_id", "prio", F.col("id").alias("ord"), "name", F.concat(F.replace("fqn", F.lit("."), F.lit("/")), F.lit(".java")).alias("candidate"), F.lit("import").alias("resolution"), F.lit(0.9).alias("base"))
    own = r.join(fixed, "ref_id", "left_anti").where(member).select(
        "ref_id", F.lit(8).alias("prio"), F.lit(0).cast("long").alias("ord"), "name", F.concat(F.when(F.col("dir") == "", "").otherwise(F.concat("dir", F.lit("/"))), "receiver", F.lit(".java")).alias("candidate"), F.lit("package").alias("resolution"), F.lit(0.85).alias("base")
    )
    tries = tries.unionByName(own)
    wanted = tries.select("candidate").distinct()
    exact = wanted.join(java.select(F.col("path").alias("candidate"), F.col("file_id").alias("s_file")), "candidate")
    rest = wanted.join(exact, "candidate", "left_anti").withColumn("base_name", paths.basename(F.col("candidate")))
    loose = rest.join(java.select("path", F.col("file_id").alias("s_file"), paths.basename(F.col("path")).alias("base_name")), "base_name").where(F.endswith("path", F.concat(F.lit("/"), F.col("candidate"))))
    s = index.symbols.select(F.col("file_id").alias("s_file"), "name", F.col("id").alias("symbol_id"))
    hits = tries.join(exact.select("candidate", "s_file").union(loose.select("candidate", "s_file")), "candidate").join(s, ["s_file", "name"]).select("ref_id", "prio", "ord", "symbol_id", "resolution", "base")
    near = s.join(java.select(F.col("file_id").alias("s_file"), "dir"), "s_file")
    sibling = r.where(~member).join(near, ["dir", "name"]).where("s_file <> file_id").select("ref_id", F.lit(9).alias("prio"), F.lit(0).cast("long").alias("ord"), "symbol_id", F.lit("package").alias("resolution"), F.lit(0.85).alias("base"))
    best = F.min(F.struct("prio", "ord")).over(Window.partitionBy("ref_id"))
    return hits.unionByName(sibling).withColumn("_b", best).where((F.col("prio") == F.col("_b.prio")) & (F.col("ord") == F.col("_b.ord"))).select("ref_id", "symbol_id", "resolution", "base").distinct()
