"""Document status from events, and documents that never finish.

The status of a document is a fold of its events that does not depend on how they are
batched, so it is a plain streaming aggregate: partial results are merged before the
shuffle, repeated events change nothing, and no Python state is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import fixed_values as V
from .audit_stream import snapshot, write_snapshot

# kinds: uploaded, processed, failed, preview_requested, preview_retry, preview_ready, preview_failed


def status_of(events: DataFrame) -> DataFrame:
    """Current status of each document (STR5): batch, or a stream in update or complete mode.

    ``events``: event_id, doc_id, ts, kind, reason. Processing clears an earlier failure.
    A preview starts on request, ends ready or failed, and leaves failed only on an explicit
    retry.
    """
    at = F.struct("ts", "event_id")

    def last(*kinds: str):
        return F.max(F.when(F.col("kind").isin(*kinds), at))

    reason = F.max_by("reason", F.when(F.col("kind").isin("processed", "failed"), at))
    folded = events.groupBy("doc_id").agg(
        last("uploaded").alias("uploaded"),
        last("processed").alias("processed"),
        last("failed").alias("failed"),
        last("preview_requested").alias("requested"),
        last("preview_retry").alias("retried"),
        last("preview_ready").alias("ready"),
        last("preview_failed").alias("broken"),
        reason.alias("reason"),
    )
    failing = F.coalesce(F.col("failed") > F.col("processed"), F.col("failed").isNotNull())
    settled = F.greatest("ready", "broken")
    preview = (
        F.when(
            settled.isNull(),
            F.when(F.coalesce("requested", "retried").isNotNull(), "GENERATING").otherwise("NOT_STARTED"),
        )
        .when(F.coalesce(F.col("ready") == settled, F.lit(False)), "READY")
        .when(F.coalesce(F.col("retried") > F.col("broken"), F.lit(False)), "GENERATING")
        .otherwise("FAILED")
    )
    return folded.select(
        "doc_id",
        F.col("processed").isNotNull().alias("ai_processed"),
        failing.alias("ai_processing_failed"),
        F.when(failing, F.col("reason")).alias("ai_failure_reason"),
        preview.alias("redacted_preview_status"),
    )


def stream_status(events: DataFrame, snapshots: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep the current status of every document (STR5).

    Each batch brings only the documents that changed; they replace their rows of the
    snapshot before it. Two folders take turns; a batch run again after a failure rewrites
    the same one.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        out = batch
        if batch_id > 0:
            before = snapshot(spark, snapshots, batch_id - 1)
            out = batch.unionByName(before.join(batch.select("doc_id"), "doc_id", "left_anti"))
        write_snapshot(out, snapshots, batch_id)

    writer = status_of(events).writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def stream_stuck(
    uploads: DataFrame, outcomes: DataFrame, limit_s: int = V.EXPECTED_SECONDS, delay: str = "10 seconds"
) -> DataFrame:
    """Documents with no outcome within ``limit_s`` seconds of their upload (STR6).

    An outer join of two streams with a time bound: Spark drops matched uploads from its
    state, and emits the others once the watermark passes their deadline. On stored events
    the same join gives the same rows.
    ``uploads``: doc_id, uploaded_at; ``outcomes``: doc_id, finished_at.
    """
    if uploads.isStreaming:
        uploads = uploads.withWatermark("uploaded_at", delay)
        outcomes = outcomes.withWatermark("finished_at", delay)
    u, o = uploads.alias("u"), outcomes.alias("o")
    in_time = (
        (F.col("u.doc_id") == F.col("o.doc_id"))
        & (F.col("o.finished_at") >= F.col("u.uploaded_at"))
        & (F.col("o.finished_at") <= F.col("u.uploaded_at") + F.expr(f"interval {int(limit_s)} seconds"))
    )
    return (
        u.join(o, in_time, "leftOuter")
        .filter(F.col("o.doc_id").isNull())
        .select(F.col("u.doc_id").alias("doc_id"), F.col("u.uploaded_at").alias("uploaded_at"), F.lit("stuck").alias("status"))
    )
