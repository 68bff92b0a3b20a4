"""Notifications raised by document events.

Each function maps a DataFrame, streaming or not, so the same code serves a live stream
and a recomputation over stored events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.listing import unread_counts
from ..operators.views import route_notifications

# fixed values: notification texts by outcome
_TEXTS = {
    "processed": ("AI processing complete for ", ""),
    "failed": ("AI processing failed for ", " -- try re-uploading"),
    "preview_ready": ("Redacted preview ready: ", ""),
    "preview_failed": ("Redacted preview failed: ", ""),
}


def stream_notify(uploads: DataFrame, users: DataFrame, departments: DataFrame) -> DataFrame:
    """A notification to the department manager for each upload: stream joined with static
    users and departments (STR3)."""
    return route_notifications(uploads, users, departments)


def stream_outcomes(events: DataFrame, users: DataFrame) -> DataFrame:
    """A notification for each finished or failed step to the user who asked for it (STR4).

    ``events``: event_id, doc_id, doc_name, kind, user_id. Unknown or deleted users get none.
    """
    text = None
    for kind, (lead, tail) in _TEXTS.items():
        line = F.concat(F.lit(lead), F.col("doc_name"), F.lit(tail))
        text = F.when(F.col("kind") == kind, line) if text is None else text.when(F.col("kind") == kind, line)
    known = users.filter(~F.col("is_deleted")).select(F.col("id").alias("user_id"))
    return (
        events.withColumn("content", text)
        .filter(F.col("content").isNotNull())
        .join(known, "user_id")
        .select(
            F.col("event_id").alias("id"), F.col("doc_id").alias("triggered_document_id"),
            F.col("user_id").alias("receiver_id"), "content",
        )
    )


def valid_marks(marks: DataFrame, notifications: DataFrame) -> DataFrame:
    """Read marks made by the receiver; anyone else may not mark (STR7).
    ``marks``: notification_id, actor_id."""
    owners = notifications.select(F.col("id").alias("notification_id"), "receiver_id")
    return (
        marks.join(owners, "notification_id")
        .filter(F.col("actor_id") == F.col("receiver_id"))
        .select("notification_id")
    )


def unread(notifications: DataFrame, marks: DataFrame) -> DataFrame:
    """Unread count per receiver after all valid marks (STR7)."""
    read_now = marks.select(F.col("notification_id").alias("id"), F.lit(True).alias("__read")).distinct()
    state = notifications.join(read_now, "id", "left").withColumn(
        "has_read", F.col("has_read") | F.coalesce("__read", F.lit(False))
    )
    return unread_counts(state)


def append_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream of rows to a table folder, exactly once."""
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path).option(
        "checkpointLocation", checkpoint
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
