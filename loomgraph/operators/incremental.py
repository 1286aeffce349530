"""What a change of files touches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import INHERITANCE_ROLES, Index


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, state): new, changed, gone or same, by content hash."""
    b, a = before.select("path", F.col("hash").alias("h0")), after.select("path", F.col("hash").alias("h1"))
    state = F.when(F.col("h0").isNull(), "new").when(F.col("h1").isNull(), "gone").when(F.col("h0") != F.col("h1"), "changed").otherwise("same")
    return b.join(a, "path", "full").select("path", state.alias("state"))


def affected_files(index: Index, names: DataFrame, changed: DataFrame) -> DataFrame:
    """Files (file_id) that changed or mention a changed name as a reference, a receiver or an import."""
    r = index.refs.join(names, "name", "left_semi").select("file_id")
    v = index.refs.join(names.select(F.col("name").alias("receiver")), "receiver", "left_semi").select("file_id")
    out = changed.select("file_id").union(r).union(v)
    for c in ("imported_name", "local_name"):
        out = out.union(index.imports.join(names.select(F.col("name").alias(c)), c, "left_semi").select("file_id"))
    return out.distinct()


def inheritance_signature(refs: DataFrame) -> DataFrame:
    """(file_id, signature): each file's inheritance references, sorted, one a line; equal signatures mean equal multisets."""
    around = F.coalesce(F.col("enclosing") if "enclosing" in refs.columns else F.col("enclosing_id").cast("string"), F.lit("-"))
    line = F.concat_ws(" ", "role", "name", F.coalesce("receiver", F.lit("-")), around)
    return refs.where(F.col("role").isin(*INHERITANCE_ROLES)).groupBy("file_id").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("signature"))


def declared_names(index: Index, files: DataFrame) -> DataFrame:
    """(name) that the files (file_id) declare, export or re-export."""
    s = index.symbols.join(files, "file_id", "left_semi")
    i = index.imports.where(F.col("kind").isin("reexport", "reexport-star")).join(files, "file_id", "left_semi")
    out = s.select("name").union(s.select("export_name")).union(i.select("local_name")).union(i.select("imported_name"))
    return out.where("name IS NOT NULL").distinct()


def dependents(index: Index, files: DataFrame) -> DataFrame:
    """(file_id) of files with an edge into the files."""
    inside = index.symbols.join(files, "file_id", "left_semi").select(F.col("id").alias("symbol_id"))
    return index.occurrences.join(inside, "symbol_id", "left_semi").select("file_id").distinct()


def resolution_facts(index: Index, files: DataFrame) -> DataFrame:
    """The rows of the files that other files' references can depend on."""
    s = index.symbols.join(files, "file_id", "left_semi").select(F.concat_ws("|", "id", "moniker", "name", "kind", "exported", "export_name", "owner_type", "is_static", "is_abstract", "param_count", "variadic").alias("fact"))
    i = index.imports.where(F.col("kind").isin("reexport", "reexport-star")).join(files, "file_id", "left_semi").select(F.concat_ws("|", "file_id", "source", "kind", "imported_name", "local_name").alias("fact"))
    p = index.files.join(files.withColumnRenamed("file_id", "id"), "id", "left_semi").select(F.concat_ws("|", "id", "path").alias("fact"))
    return s.union(i).union(p)


def differ(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables of one shape hold different rows, repeats included."""
    return not (a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty())


def scope(before: Index, after: Index, moved: DataFrame) -> DataFrame | None:
    """(file_id) of the files whose references a change of the files ``moved`` can touch, or None where that may be any file: when
    what inherits from what has changed, or a name that is re-exported came or went."""
    if differ(*(inheritance_signature(x.refs.join(moved, "file_id", "left_semi")) for x in (before, after))):
        return None
    names = [declared_names(x, moved) for x in (before, after)]
    passed = before.imports.union(after.imports.select(before.imports.columns)).where("kind IN ('reexport', 'reexport-star')").select(F.col("imported_name").alias("name"))
    turned = names[0].exceptAll(names[1]).union(names[1].exceptAll(names[0]))
    if not turned.join(passed, "name", "left_semi").isEmpty() or not turned.isEmpty() and not passed.where("name IS NULL").isEmpty():
        return None
    if not differ(*(resolution_facts(x, moved) for x in (before, after))):
        return affected_files(after, names[0].limit(0), moved)
    return affected_files(after, names[0].union(names[1]).distinct(), moved.union(dependents(before, moved)))
