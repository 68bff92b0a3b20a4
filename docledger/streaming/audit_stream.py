"""Audit entries arriving as a stream."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed_values as V
from ..operators.listing import newest_n
from ..sources.audit_log import to_lines


def stream_audit(entries: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append every entry to its day's folder, exactly once (STR1)."""
    writer = (
        to_lines(entries)
        .select(F.date_format("dt", "yyyy-MM-dd").alias("dt"), "value")
        .writeStream.format("text")
        .partitionBy("dt")
        .outputMode("append")
        .option("path", root)
        .option("checkpointLocation", checkpoint)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_newest(
    entries: DataFrame, snapshots: str, checkpoint: str, n: int = V.AUDIT_CAPACITY, once: bool = True
) -> StreamingQuery:
    """Keep the newest ``n`` entries (STR2).

    Each batch joins the snapshot of the batch before it with the newest of its own
    entries, and writes the next snapshot. Two folders take turns. A batch that is run again
    after a failure reads the same snapshot and overwrites the same folder, so nothing is
    counted twice.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged = newest_n(batch, n)
        if batch_id > 0:
            merged = newest_n(snapshot(spark, snapshots, batch_id - 1).unionByName(merged), n)
        write_snapshot(merged, snapshots, batch_id)

    writer = entries.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_snapshot(rows: DataFrame, snapshots: str, batch_id: int) -> None:
    """Write what holds after a batch, over what held two batches before."""
    rows.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{snapshots}/side={batch_id % 2}")


def snapshot(spark: SparkSession, snapshots: str, batch_id: int) -> DataFrame:
    """What holds after a batch, the last or the one before it."""
    return spark.read.parquet(f"{snapshots}/side={batch_id % 2}").filter(F.col("batch_id") == batch_id).drop("batch_id")


def throttled(spark: SparkSession, path: str, schema: str, max_files: int = 50, fmt: str = "json") -> DataFrame:
    """A stream of files that admits at most ``max_files`` per batch; waiting files stay in
    the folder instead of a queue that could overflow (STR8)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)


def write_with_dead_letters(
    processed: DataFrame, out: str, dead: str, checkpoint: str, error: str = "error", once: bool = True
) -> StreamingQuery:
    """Rows with an error go to a dead-letter folder, the others to the output; none is
    dropped (STR8)."""

    def split(batch: DataFrame, batch_id: int) -> None:
        # kept while it is written twice, so that the work is done once
        marked = batch.withColumn("batch_id", F.lit(batch_id)).persist()
        marked.filter(F.col(error).isNull()).write.mode("overwrite").parquet(os.path.join(out, f"part={batch_id}"))
        marked.filter(F.col(error).isNotNull()).write.mode("overwrite").parquet(os.path.join(dead, f"part={batch_id}"))
        marked.unpersist()

    writer = processed.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
