"""A stream of change batches (path, content; null content deletes) kept as a current file table and an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.build import Layout
from ..plans.lineage import cut
from ..plans.store import Store

SCHEMA = "path string, content string, seq long"
DEBOUNCE = "750 milliseconds"


def applied(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files (path, content) after changes: the last by ``seq`` of each path holds."""
    last = Window.partitionBy("path").orderBy(F.desc("seq"))
    c = changes.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    kept = files.join(c, "path", "left_anti").select("path", "content")
    return kept.unionByName(c.where("content IS NOT NULL").select("path", "content"))


def watch(changes: DataFrame, store: Store, files: DataFrame, checkpoint: str, once: bool = False, layout: Layout = Layout()):
    """Start a streaming query that syncs the store batch by batch. The store keeps the current sources, so a restart goes on from
    there; ``files`` serve where it has none yet. A batch that is run again gives the same state."""

    def on_batch(batch: DataFrame, _: int) -> None:
        known = store.table("sources")
        store.sync(cut(applied(files if known is None else known, batch)), layout, keep_sources=True)

    writer = changes.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=DEBOUNCE)).start()
