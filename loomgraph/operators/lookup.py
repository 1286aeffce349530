"""Point lookups, listings, counts and empty-result diagnosis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import paths
from ..schemas import FANOUT_CAP, MAX_RESULTS, Index, limited


def with_path(index: Index, rows: DataFrame) -> DataFrame:
    return rows.join(index.files.select(F.col("id").alias("file_id"), "path", "lang"), "file_id")


def definitions(index: Index, name: str, limit: int = 20) -> DataFrame:
    """Symbols of a name, exported ones first, then by path and place."""
    hits = with_path(index, index.symbols.where(F.col("name") == name))
    return hits.orderBy(F.desc("exported"), "path", "s_line", "s_col", "id").limit(limited(limit, MAX_RESULTS))


def definition_by_moniker(index: Index, moniker: str) -> DataFrame:
    return with_path(index, index.symbols.where(F.col("moniker") == moniker)).limit(1)


def has_definition(index: Index, wanted: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """Rows (name, lang) of ``wanted`` that have a symbol of that name and language [and of one of the kinds]."""
    have = with_path(index, index.symbols if kinds is None else index.symbols.where(F.col("kind").isin(*kinds)))
    return wanted.join(have, ["name", "lang"], "left_semi")


def files_like(index: Index, pattern: str | None = None, limit: int = MAX_RESULTS) -> DataFrame:
    """Files by path; * in the pattern is any text, letters match in either case, _ and % stay wildcards."""
    rows = index.files if pattern is None else index.files.where(F.col("path").ilike("%" + pattern.replace("*", "%") + "%"))
    return rows.orderBy("path").limit(limited(limit, MAX_RESULTS))


def symbol_at(index: Index, places: DataFrame) -> DataFrame:
    """For each place (file_id, line, col): the smallest symbol that contains it, ends included; the first of equals."""
    s = index.symbols.select("file_id", F.col("id").alias("symbol_id"), "name", "s_line", "s_col", "e_line", "e_col")
    after = (F.col("line") > F.col("s_line")) | ((F.col("line") == F.col("s_line")) & (F.col("col") >= F.col("s_col")))
    until = (F.col("line") < F.col("e_line")) | ((F.col("line") == F.col("e_line")) & (F.col("col") <= F.col("e_col")))
    span = (F.col("e_line") - F.col("s_line")).cast("long") * 100_000 + F.col("e_col") - F.col("s_col")
    inside = places.join(s, "file_id").where(after & until)
    return inside.groupBy(*places.columns).agg(F.min(F.struct(span.alias("span"), F.col("symbol_id"), F.col("name"))).alias("s")).select(*places.columns, "s.symbol_id", "s.name")


def symbol_at_name(index: Index, places: DataFrame) -> DataFrame:
    """Symbols whose name token starts exactly at (file_id, line, col)."""
    s = index.symbols.select("file_id", F.col("name_s_line").alias("line"), F.col("name_s_col").alias("col"), F.col("id").alias("symbol_id"), "name")
    return places.join(s, ["file_id", "line", "col"])


def dir_siblings(index: Index) -> DataFrame:
    """(file_id, sibling_id) of different files in one directory."""
    d = index.files.select(F.col("id").alias("file_id"), paths.dirname(F.col("path")).alias("dir"))
    return d.join(d.withColumnRenamed("file_id", "sibling_id"), "dir").where("file_id <> sibling_id").select("file_id", "sibling_id")


def suffix_match(index: Index, suffixes: DataFrame) -> DataFrame:
    """Files whose path ends with a suffix at a segment's start: equal base names, then the rest of the suffix."""
    f = index.files.select("id", "path", paths.basename(F.col("path")).alias("base"))
    s = suffixes.withColumn("base", paths.basename(F.col("suffix")))
    return s.join(f, "base").where((F.col("path") == F.col("suffix")) | F.endswith("path", F.concat(F.lit("/"), F.col("suffix")))).select("suffix", F.col("id").alias("file_id"), "path")


def status_counts(index: Index) -> DataFrame:
    """One row: files, symbols, occurrences."""
    counts = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("k"), "n") for k, d in (("files", index.files), ("symbols", index.symbols), ("occurrences", index.occurrences))]
    every = counts[0].union(counts[1]).union(counts[2])
    return every.agg(*[F.max(F.when(F.col("k") == k, F.col("n"))).alias(k) for k in ("files", "symbols", "occurrences")])


def totals_by_symbol(index: Index, roles: tuple[str, ...]) -> DataFrame:
    """Incoming and outgoing sites per symbol; symbols without any are left out."""
    o = index.occurrences.where(F.col("role").isin(*roles))
    ends = o.select(F.explode(F.array(F.struct(F.col("symbol_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("enclosing_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x"))
    return ends.select("x.*").where("id IS NOT NULL").groupBy("id").agg(F.sum("i").alias("callers"), F.sum("o").alias("callees")).withColumnRenamed("id", "symbol_id")


def per_name(index: Index) -> DataFrame:
    """Definitions, sites (references by name) and bound edges of every name."""
    names = index.symbols.groupBy("name").agg(F.count("*").alias("definitions"))
    bound = index.occurrences.join(index.symbols.select(F.col("id").alias("symbol_id"), "name"), "symbol_id").groupBy("name").agg(F.count("*").alias("bound"))
    sites = index.refs.groupBy("name").agg(F.count("*").alias("sites"))
    return names.join(bound, "name", "full").join(sites, "name", "full").na.fill(0, ["definitions", "bound", "sites"])


def fanout_risk(index: Index) -> DataFrame:
    """Names with more definitions than the fan-out cap and at least one reference."""
    return per_name(index).where((F.col("definitions") > FANOUT_CAP) & (F.col("sites") > 0)).select("name", "definitions", "sites")


def empty_reason(definitions: Column, bound: Column, sites: Column) -> Column:
    return F.when(definitions == 0, "no-symbol").when((definitions > FANOUT_CAP) & (bound == 0) & (sites > 0), "suppressed").otherwise("no-edges")


def diagnose_empty(index: Index) -> DataFrame:
    """Why a name's queries come back empty, for each name without a bound edge."""
    reason = empty_reason(F.col("definitions"), F.col("bound"), F.col("sites"))
    return per_name(index).where("bound = 0").select("name", reason.alias("reason"), "definitions", "sites")


def top_definitions(index: Index, k: int = 3) -> DataFrame:
    """The first k definitions of every name, in the order of ``definitions``."""
    w = Window.partitionBy("name").orderBy(F.desc("exported"), "path", "s_line", "s_col", "id")
    return with_path(index, index.symbols).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def exported_of(index: Index, files: DataFrame) -> DataFrame:
    """Exported symbols of files (file_id)."""
    return with_path(index, index.symbols.where("exported").join(files, "file_id", "left_semi"))


def file_meta(index: Index, wanted: DataFrame) -> DataFrame:
    """The index's files with one of the paths (path)."""
    return index.files.join(wanted, "path", "left_semi")
