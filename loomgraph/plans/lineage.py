"""Lineage cuts through the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's spark.checkpoint.dir and go on from there. Where that is unset, a folder of our own serves, on a
    single machine only."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        known = spark.conf.get("spark.checkpoint.dir", None)
        if known is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(known or tempfile.mkdtemp(prefix="ckpt_"))
    return df.checkpoint(eager=True)
