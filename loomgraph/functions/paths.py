"""Path, language and file-name tests as Column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directories never entered, directories and names of generated code, languages by extension.
PRUNED = (".git", ".hg", ".svn", ".codeindex", "node_modules", "dist", "build", "out", "target", "vendor", "coverage", "tmp", "venv", ".venv", "__pycache__")
GENERATED_DIRS = ("generated", "__generated__", "codegen", "__codegen__", "generated-sources", "generated_sources", "openapi-generated", ".openapi-generator")
GENERATED_NAMES = (
    r"\.generated\.", r"_generated\.", r"_gen\.", r"\.pb\.", r"_pb2\.py$", r"_sqlc\.go$", r"\.g\.[^.]+$", r"\.min\.[^.]+$", r"(?:^|[.-])(?:bundle|chunk)(?:[.-]|$)", r"\.d\.(?:ts|mts|cts)$",
)
LANGUAGES = {
    "typescript": (".ts", ".mts", ".cts"), "tsx": (".tsx",), "javascript": (".js", ".mjs", ".cjs", ".jsx"), "python": (".py", ".pyi"), "go": (".go",), "ruby": (".rb", ".rake"), "java": (".java",), "csharp": (".cs",),
    "scala": (".scala", ".sbt", ".sc"), "php": (".php",), "c": (".c",), "cpp": (".cpp", ".cc", ".cxx", ".c++", ".hpp", ".hh", ".hxx", ".h"), "rust": (".rs",), "kotlin": (".kt", ".kts"),
}
PRECEDENCE = {".js": (".ts", ".tsx"), ".mjs": (".mts", ".ts"), ".cjs": (".cts", ".ts"), ".jsx": (".tsx",)}
BY_EXTENSION = {e: lang for lang, es in LANGUAGES.items() for e in es}


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]*$", 0))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/?[^/]*$", "")


def language(path: Column) -> Column:
    """Language id, or null."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(BY_EXTENSION.items())])
    return F.element_at(table, extension(path))


def family(lang: Column) -> Column:
    """Languages whose names resolve into each other share a family."""
    return F.when(lang.isin("typescript", "tsx", "javascript"), "ecmascript").otherwise(lang)


def is_pruned(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: F.startswith(s, F.lit(".")) | s.isin(*PRUNED))


def is_generated_path(path: Column) -> Column:
    inside = F.exists(F.slice(F.split(F.lower(path), "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda s: s.isin(*GENERATED_DIRS))
    return inside | F.lower(basename(path)).rlike("|".join(GENERATED_NAMES))


def is_safe(path: Column) -> Column:
    """A relative path without empty, dot or backslash parts."""
    bad = F.exists(F.split(path, "/"), lambda s: s.isin("", ".", ".."))
    return (path != "") & ~F.contains(path, F.lit("\0")) & ~F.contains(path, F.lit("\\")) & ~path.rlike("^[A-Za-z]:") & ~bad


def normalised(path: Column) -> Column:
    """The path with . and .. parts resolved; .. above the root stay."""
    up = F.lit("..")
    fold = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda a, s: F.when(s.isin("", "."), a)
        .when((s == up) & (F.size(a) > 0) & (F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit("")) != up), F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
        .otherwise(F.concat(a, F.array(s))),
    )
    return F.array_join(fold, "/")


def visit_key(path: Column) -> tuple[Column, Column]:
    """The order in which a walk meets files: a directory's own files by name, then its directories from the last name to the
    first, each with all it holds. First the directory: its segments' bytes inverted, so that they order from last to first."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, F.lit(1), F.size(parts) - 1)
    inverted = F.transform(dirs, lambda s: F.concat(F.translate(F.hex(F.encode(s, "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("G")))
    return F.array_join(inverted, ""), basename(path)


def subsequence(needle: str, text: Column) -> Column:
    """Whether the needle's characters stand in the text in order."""
    return text.rlike("(?s)" + ".*".join("\\Q" + c + "\\E" for c in needle if c != "\\") if needle else "")
