"""Shared helpers: column normalisation, Arrow row mapping, lineage cuts."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) only, a null text read as empty; all other columns are left behind, so none can clash."""
    return df.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
    )


def map_texts(df: DataFrame, make: Callable[[], Callable[[list[str]], dict[str, list]]], schema: str, id_type: str = "long") -> DataFrame:
    """Map (doc_id, text) batches to one row per document: doc_id (of ``id_type``) plus the columns of ``schema``.

    ``make`` runs once per Python worker task and returns the batch function, so that models load once per task.
    """
    fields = [x.strip().split(" ") for x in schema.split(",")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for b in batches:
            if not b.num_rows:
                continue
            got = fn(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id")] + [pa.array(got[n], kinds[t]) for n, t in fields], names=["doc_id"] + [n for n, _ in fields]
            )

    return df.mapInArrow(run, f"doc_id {id_type}, {schema}")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Where it is unset, a folder of our own, on a single machine only (tests)."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if known is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return known or tempfile.mkdtemp(prefix="shared_")


FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from those files. The shuffle files of that job are deleted as it ends."""
    sc, conf = df.sparkSession.sparkContext, df.sparkSession.conf
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    before = conf.get(FILE_CLEANUP, None)
    conf.set(FILE_CLEANUP, "true")
    try:
        once = df.select("*")  # a plan takes the setting as it is made; this one runs once, so nothing asks for its files again
    finally:
        conf.unset(FILE_CLEANUP) if before is None else conf.set(FILE_CLEANUP, before)
    return once.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let go of the checkpoint files and broadcasts of tables that aren't referred to any more. Spark deletes them when the driver's
    objects are collected, which takes one to several collections and else may come long after the job; shuffle files don't wait
    for that (``cut``)."""
    gc.collect()
    spark._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


HOT_SHARE = 1000


def lookup(rows: DataFrame, facts: DataFrame, key: str | list[str], total: int) -> DataFrame:
    """``rows`` joined to ``facts`` (one row a key, ``n`` = how many of the ``total`` rows have it) by ``key``.

    Keys with more than a 1 / HOT_SHARE of all rows are broadcast, HOT_SHARE facts at most; their rows aren't shuffled, so no
    key lands in one task. ``rows`` is read twice: give a checkpoint or a scan. Null keys find nothing.
    """
    limit = max(1, total // HOT_SHARE)
    hot, cold = facts.where(F.col("n") > limit).drop("n"), facts.where(F.col("n") <= limit).drop("n")
    near = rows.join(F.broadcast(hot), key)
    return near.unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
