"""Structural search: a pattern over the syntax trees of one language's files."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.build import FrontEnd, front_ends
from ..sources import patterns
from .render import one_line

MOST_FILES = 2000


def match(files: DataFrame, lang: str, pattern: str, path: str | None = None, limit: int = 100, most_files: int = MOST_FILES, ends: dict[str, FrontEnd] | None = None) -> DataFrame:
    """(path, s_line, s_col, e_line, e_col, captures) of the first ``limit`` matches by path and place in files (path, lang, content).

    path: a part of the paths looked at, in its letters' own case. The pattern is compiled before any file is read; more than
    ``most_files`` files in scope are refused.
    """
    compiled = patterns.compiled(lang, pattern)
    scope = files.where(F.col("lang") == lang)
    if path is not None:
        scope = scope.where(F.contains("path", F.lit(path)))
    count = scope.count()
    if count > most_files:
        raise ValueError(f"structural search scope too broad: {count} {lang} files exceed the {most_files}-file cap; narrow with a path filter.")

    def run(batches):
        by_lang = front_ends() if ends is None else ends
        names = ["path", "ord", "s_line", "s_col", "e_line", "e_col", "captures"]
        for b in batches:
            rows = []
            for name, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist()):
                found = by_lang[lang](content or "")
                for k, hit in enumerate(patterns.matches(compiled, patterns.tree(lang, content or "", found)) if found else ()):
                    spans = [n.range for _, n in hit]
                    rows.append((name, k, *min(s[:2] for s in spans), *max(s[2:] for s in spans), [{"name": c, "text": n.text} for c, n in hit]))
            kinds = (pa.string(), *[pa.int32()] * 5, pa.list_(pa.struct([("name", pa.string()), ("text", pa.string())])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    schema = "path string, ord int, s_line int, s_col int, e_line int, e_col int, captures array<struct<name: string, text: string>>"
    hits = scope.select("path", "content").mapInArrow(run, schema).orderBy("path", "ord")
    return hits.limit(max(limit, 0)).drop("ord")


def match_line() -> Column:
    """path:line  name=text  name=text"""
    return F.concat(F.col("path"), F.lit(":"), F.col("s_line").cast("string"), F.lit("  "), F.array_join(F.transform("captures", lambda c: F.concat(c["name"], F.lit("="), one_line(c["text"]))), "  "))
