"""Clean-up of parsed facts, and set-based containment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

NAME_RANGE = ["name_s_line", "name_s_col", "name_e_line", "name_e_col"]
RANGE = ["s_line", "s_col", "e_line", "e_col"]


def span(weight: int = 100_000):
    return (F.col("e_line") - F.col("s_line")).cast("long") * weight + F.col("e_col") - F.col("s_col")


def dedupe_symbols(symbols: DataFrame) -> DataFrame:
    """One symbol per name token: interfaces before methods before owned ones before others, then the larger span, then the first."""
    rank = F.when(F.col("kind") == "interface", 3).when(F.col("kind") == "method", 2).when(F.col("owner_type").isNotNull(), 1).otherwise(0)
    w = Window.partitionBy("file_id", *NAME_RANGE).orderBy(F.desc(rank), F.desc(span()), "id")
    return symbols.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def dedupe_refs(refs: DataFrame) -> DataFrame:
    """The first reference of each name, role, range and receiver."""
    w = Window.partitionBy("file_id", "name", "role", *RANGE, "receiver").orderBy("id")
    return refs.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def drop_definition_refs(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """References whose range is a definition's own name go."""
    names = symbols.select("file_id", *[F.col(n).alias(r) for n, r in zip(NAME_RANGE, RANGE)])
    return refs.join(names, ["file_id", *RANGE], "left_anti")


def merge_relations(refs: DataFrame, relations: DataFrame) -> DataFrame:
    """Relations take the place of references with exactly their range."""
    return refs.join(relations, ["file_id", *RANGE], "left_anti").unionByName(relations)


def enclosing(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """refs with ``enclosing_id``: the smallest symbol that contains the start, ends included; the first of equals; else null."""
    s = symbols.select("file_id", F.col("id").alias("_sid"), *[F.col(c).alias("_" + c) for c in RANGE])
    at = lambda p, q: (F.col(p + "line") < F.col(q + "line")) | ((F.col(p + "line") == F.col(q + "line")) & (F.col(p + "col") <= F.col(q + "col")))
    size = (F.col("_e_line") - F.col("_s_line")).cast("long") * 100_000 + F.col("_e_col") - F.col("_s_col")
    best = refs.join(s, "file_id").where(at("_s_", "s_") & at("s_", "_e_")).groupBy("id").agg(F.min(F.struct(size.alias("z"), "_sid")).alias("m"))
    return refs.join(best.select("id", F.col("m._sid").alias("enclosing_id")), "id", "left")
