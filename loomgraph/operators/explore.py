"""A symbol's surroundings in one table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CALL_ROLES, INHERITANCE_ROLES, Index
from . import graph, lookup

PER_SECTION, IMPACT_ROWS = 15, 200


def explore(index: Index, name: str | None = None, moniker: str | None = None) -> DataFrame:
    """(section, label, path, s_line, confidence, sites). A name with more or fewer than one definition gives its candidates only."""
    if name is not None:
        found = lookup.definitions(index, name, PER_SECTION)
        monikers = [r["moniker"] for r in found.select("moniker").limit(2).collect()]
        if len(monikers) != 1:
            return _symbols(found, "candidate")
        moniker = monikers[0]
    own = lookup.definition_by_moniker(index, moniker)
    sides = [("caller", graph.incoming(index, CALL_ROLES, None, moniker, PER_SECTION), "source"), ("callee", graph.outgoing(index, CALL_ROLES, None, moniker, PER_SECTION), "target")]
    sides += [("implementer", graph.incoming(index, INHERITANCE_ROLES, None, moniker, PER_SECTION), "source"), ("supertype", graph.outgoing(index, INHERITANCE_ROLES, None, moniker, PER_SECTION), "target")]
    out = _symbols(own, "symbol")
    for section, rows, label in sides:
        out = out.unionByName(rows.select(F.lit(section).alias("section"), F.col(label).alias("label"), "path", "s_line", "confidence", F.lit(None).cast("long").alias("sites")))
    far = graph.impact(index, moniker=moniker, depth=2, limit=IMPACT_ROWS).groupBy("depth").agg(F.count("*").alias("sites"))
    far = far.select(F.concat(F.lit("impact "), F.col("depth").cast("string")).alias("section"), F.lit(None).cast("string").alias("label"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("int").alias("s_line"), F.lit(None).cast("double").alias("confidence"), "sites")
    return out.unionByName(far)


def _symbols(rows: DataFrame, section: str) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), F.col("moniker").alias("label"), "path", "s_line", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("long").alias("sites"))
