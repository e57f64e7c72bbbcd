"""Streams: run states, incremental node snapshots, audit rows, and windowed event counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from graphloom.operators.indexing import merged
from graphloom.sources.versioned import Manifest, VersionedTable, list_files
from graphloom.tables import latest


def fold_into(table: VersionedTable, batch: DataFrame, batch_id: int, key: list[str], order: str, values: list[str], source: str) -> bool:
    """Merges a micro-batch into the newest state per key; a batch that was merged before is left alone.

    The new snapshot and the batch's number are one commit, so a batch that is delivered again after a failure changes
    nothing. Later rows win, whatever batch they came in.
    """
    base = table.manifest()
    if base.processed.get(source, -1) >= batch_id:
        return False
    fresh = latest(batch, key, order, values)
    if base.files:
        old = table.rows(base.version).select(*key, order, *values)
        touched = old.join(fresh.select(*key).distinct(), key, "left_semi")
        fresh = latest(touched.unionByName(fresh), key, order, values)
        fresh = merged(old, fresh, key)
    part = f"{table.root}/data/{batch_id}-{base.version}"
    fresh.write.mode("overwrite").parquet(part)
    table.commit(Manifest(base.version + 1, list_files(table.spark, part), [], base.processed | {source: batch_id}))
    return True


def stream_states(spark: SparkSession, source: DataFrame, root: str, checkpoint: str, key: list[str], order: str, values: list[str], name: str = "stream") -> StreamingQuery:
    """Keeps the newest state per key of a stream below ``root``, all that is available now, exactly once."""
    table = VersionedTable(spark, root)

    def each(batch: DataFrame, batch_id: int) -> None:
        fold_into(table, batch, batch_id, key, order, values, name)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_audit(source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Audit rows (who asked for what, and what was returned), appended once each."""
    return source.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Events per type and window of event time; rows later than the watermark are dropped when streaming."""
    at = F.window(F.col("ts").cast("timestamp"), width, slide) if slide else F.window(F.col("ts").cast("timestamp"), width)
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(at.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", F.round("total", 6).alias("total"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each user: events with less than ``gap`` between them."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
