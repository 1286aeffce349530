"""Accuracy of edges against an authoritative set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import provenance_rank


def band(confidence: Column) -> Column:
    return F.when(confidence >= 0.9, ">=0.9").when(confidence >= 0.5, "0.5-0.89").otherwise("<0.5")


def by_band(edges: DataFrame, oracle: DataFrame, keys: list[str]) -> DataFrame:
    """(band, edges, correct): how many of the edges of each score band the oracle (distinct keys) has."""
    hit = oracle.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return edges.join(hit, keys, "left").groupBy(band(F.col("confidence")).alias("band")).agg(F.count("*").alias("edges"), F.count("_hit").alias("correct"))


def recall(edges: DataFrame, oracle: DataFrame, keys: list[str]) -> DataFrame:
    """One row: oracle places, and those among them that the edges have."""
    o = oracle.select(*keys).distinct()
    found = edges.select(*keys).distinct().withColumn("_hit", F.lit(1))
    return o.join(found, keys, "left").agg(F.count("*").alias("places"), F.count("_hit").alias("found"))


def accuracy(edges: DataFrame, oracle: DataFrame) -> DataFrame:
    """One row on how the edges (file_id, s_line, s_col, symbol_id, confidence, provenance) meet an authoritative set of them.

    A place is a (file, line, column). ``places``: those of the oracle; ``comparable``: those with any edge; ``recalled``: an edge has
    one of the oracle's targets; ``top1``: the first edge by score, provenance and id has; ``unique_top`` and ``unique_top_right``:
    places with one best score, and those where it is right; ``high`` and ``high_right``: places whose best score is 0.9 or more, and
    those where that one is right; ``tied``: the oracle's target shares the best score but isn't first; ``below``: it scores less;
    ``missed``: it isn't among the edges; ``candidates`` and ``most``: edges in all, and at one place.
    """
    place = ["file_id", "s_line", "s_col"]
    truth = oracle.select(*place, "symbol_id").distinct().withColumn("_t", F.lit(True))
    o = truth.select(*place).distinct()
    best = Window.partitionBy(*place, "symbol_id").orderBy(F.desc("confidence"), F.desc(provenance_rank(F.col("provenance"))), "id")
    one = edges.join(o, place, "left_semi").withColumn("_n", F.row_number().over(best)).where("_n = 1").join(truth, [*place, "symbol_id"], "left")
    order = Window.partitionBy(*place).orderBy(F.desc("confidence"), F.desc(provenance_rank(F.col("provenance"))), "symbol_id")
    at = Window.partitionBy(*place)
    right = F.col("_t").isNotNull()
    c = one.withColumn("_r", F.row_number().over(order)).withColumn("_top", F.max("confidence").over(at))
    per = c.groupBy(*place).agg(
        F.max("_top").alias("top"), F.count("*").alias("n"), F.max(right).alias("hit"), F.max(right & (F.col("_r") == 1)).alias("first"),
        F.sum((F.col("confidence") == F.col("_top")).cast("int")).alias("tops"), F.max(right & (F.col("confidence") == F.col("_top"))).alias("among"),
    )
    count = lambda on, name: F.count_if(on).alias(name)
    return o.join(per, place, "left").agg(
        F.count("*").alias("places"), F.count("n").alias("comparable"), count(F.col("hit"), "recalled"), count(F.col("first"), "top1"), count(F.col("tops") == 1, "unique_top"),
        count((F.col("tops") == 1) & F.col("first"), "unique_top_right"), count(F.col("top") >= 0.9, "high"), count((F.col("top") >= 0.9) & F.col("first"), "high_right"),
        count(F.col("among") & ~F.col("first"), "tied"), count(F.col("hit") & ~F.col("among"), "below"), count(~F.col("hit"), "missed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("candidates"), F.coalesce(F.max("n"), F.lit(0)).alias("most"),
    )
