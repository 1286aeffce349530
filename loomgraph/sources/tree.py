"""Source files of a tree as a DataFrame, and the filters that choose what is indexed."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from ..schemas import FILE_CAP, MAX_FILE_BYTES
from .ignore import Rules

#: What a generated file's leading comment says.
BANNERS = [re.compile(p, re.I) for p in (r"@generated", r"\bgenerated by\b", r"\bdo not edit\b", r"\bautomatically generated\b", r"\bcode generated .* do not edit\b")]
#: Blank lines and comments that a text begins with; a block comment may end anywhere in its last line.
LEADING = re.compile(r"(?:[ \t\r\f\v]*(?:(?://|\#)[^\n]*|/\*.*?(?:\*/[^\n]*|\Z))?(?:\n|\Z))*", re.S)
BANNER_LINES = 40


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to root, size, mtime_ms, visit) of every file, ``visit`` in the order of the walk. Spark's own listing leaves
    out names with a leading underscore. Links, pruned directories, what ignore files exclude and repositories inside the tree
    aren't entered."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    base = base.rstrip("/")
    local = isinstance(store, fs.LocalFileSystem)
    texts: dict[str, str] = {}
    rules = Rules({})
    rows, todo = [], [base]
    while todo:
        here = todo.pop()
        found = sorted(store.get_file_info(fs.FileSelector(here)), key=lambda f: f.base_name.encode())
        names = {f.base_name: f for f in found}
        if here != base and ".git" in names:
            continue
        if ".gitignore" in names and names[".gitignore"].type == fs.FileType.File and not (local and os.path.islink(names[".gitignore"].path)):
            with store.open_input_stream(names[".gitignore"].path) as f:
                texts[here[len(base) + 1 :]] = f.read().decode(errors="replace")
            rules = Rules(texts)
        for f in found:
            rel = f.path[len(base) + 1 :]
            if local and os.path.islink(f.path):
                continue
            if f.type == fs.FileType.Directory:
                if f.base_name not in paths.PRUNED and not f.base_name.startswith(".") and not rules.ignores(rel, True):
                    todo.append(f.path)
            elif f.type == fs.FileType.File and not rules.ignores(rel):
                rows.append((rel, f.size, f.mtime_ns / 1e6 if f.mtime_ns else 0.0, len(rows)))
    return spark.createDataFrame(rows, "path string, size long, mtime_ms double, visit long")


def read_text(root: str, name: str) -> str | None:
    """A small file of the tree, or None."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
    try:
        with store.open_input_stream(f"{base.rstrip('/')}/{name}") as f:
            return f.read().decode(errors="replace")
    except OSError:
        return None


def contained(root: str, path: str) -> str | None:
    """The real place of a relative path, if it is inside of the root and no link itself."""
    if not path or "\0" in path or "\\" in path or path.startswith("/") or re.match("[A-Za-z]:", path) or any(s in ("", ".", "..") for s in path.split("/")):
        return None
    base, full = os.path.realpath(root), os.path.join(root, path)
    real = os.path.realpath(full)
    return real if os.path.lexists(full) and not os.path.islink(full) and real.startswith(base + os.sep) else None


def read_files(listing: DataFrame, root: str) -> DataFrame:
    """The listing with ``content``: undecodable bytes become U+FFFD; a file that is gone meanwhile is left out."""

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)
        for b in batches:
            kept, text = [], []
            for k, path in enumerate(b.column("path").to_pylist()):
                try:
                    with store.open_input_stream(f"{base.rstrip('/')}/{path}") as f:
                        text.append(f.read().decode(errors="replace"))
                    kept.append(k)
                except FileNotFoundError:
                    continue
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(kept, pa.int64())).columns, pa.array(text, pa.string())], names=[*b.schema.names, "content"])

    return listing.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in listing.schema.fields) + ", content string")


def banner(content: str) -> str:
    """The comments at the head of the first 40 lines, without #! lines."""
    head = "\n".join(content.split("\n", BANNER_LINES)[:BANNER_LINES])
    return re.sub(r"(?m)^\s*#!.*$", "", LEADING.match(head)[0])


def has_generated_banner(content: str) -> bool:
    text = banner(content)
    return any(p.search(text) for p in BANNERS)


def precedence_losers(files: DataFrame) -> DataFrame:
    """(path) of files that a sibling of a preferred extension stands for."""
    f = files.select("path", paths.extension(F.col("path")).alias("ext"), F.regexp_replace("path", r"\.[^./]*$", "").alias("stem"))
    rules = [(e, p) for e, ps in paths.PRECEDENCE.items() for p in ps]
    rules = F.broadcast(files.sparkSession.createDataFrame(rules, "ext string, preferred string"))  # six rows
    over = f.select("stem", F.col("ext").alias("preferred"))
    return f.join(rules, "ext").join(over, ["stem", "preferred"], "left_semi").select("path").distinct()


def indexable(listing: DataFrame) -> DataFrame:
    """Listed files (path, size) that may be indexed, with their language: by path, size and preferred siblings."""
    kept = listing.where(paths.is_safe(F.col("path")) & ~paths.is_pruned(F.col("path")) & ~paths.is_generated_path(F.col("path")) & (F.col("size") <= MAX_FILE_BYTES))
    kept = kept.withColumn("lang", paths.language(F.col("path"))).where("lang IS NOT NULL")
    return kept.join(precedence_losers(listing), "path", "left_anti")


def first_of(files: DataFrame, cap: int = FILE_CAP) -> tuple[DataFrame, bool]:
    """The first ``cap`` files in the order of the walk, and whether more were left out."""
    order = ["visit"] if "visit" in files.columns else list(paths.visit_key(F.col("path")))
    more = files.limit(cap + 1).count() > cap
    return (files.orderBy(*order).limit(cap) if more else files), more


def choose(listing: DataFrame, ignore: dict[str, str] | None = None, cap: int = FILE_CAP) -> DataFrame:
    """Listed files that may be indexed, the first ``cap`` of the walk. Contents aren't read for that.

    ignore: texts of ignore files by directory, for listings that don't come from list_tree().
    """
    kept = indexable(listing)
    if ignore:
        rules = Rules(ignore)
        keep = F.pandas_udf(lambda s: s.map(lambda p: not rules.ignores(p)), "boolean")
        kept = kept.where(keep("path"))
    return first_of(kept, cap)[0]


def not_generated(files: DataFrame) -> DataFrame:
    """Files without a generated-code banner."""

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([not has_generated_banner(c or "") for c in b.column("content").to_pylist()], pa.bool_()))

    return files.mapInArrow(run, files.schema)
