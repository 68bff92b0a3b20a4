"""Queries that run a stream over a given table to its end and read what it wrote."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..session import scratch_path
from ..sources.audit_log import parse_audit_lines
from ..streaming import audit_stream, notify_stream, status_stream
from .driver_views import VIEWS, spark_sql_text
from .registry import Tables, query


def _stream(t: Tables, table: str) -> DataFrame:
    """A given table as a stream of files."""
    return (
        t.spark.readStream.schema(t[table].schema).option("pathGlobFilter", f"{table}.parquet").parquet(t.folder)
    )


def _audit_stream(t: Tables) -> DataFrame:
    return t.spark.sql(spark_sql_text(VIEWS["v_audit"]), events=_stream(t, "events"))


def _done(q) -> int:
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    batches = [p["batchId"] for p in q.recentProgress]
    return max(batches) if batches else 0


def _last_snapshot(t: Tables, root: str) -> DataFrame:
    """The snapshot of the last batch that ran, the newest of two folders."""
    last = t.spark.read.parquet(root).agg(F.max("batch_id")).first()[0]
    return audit_stream.snapshot(t.spark, root, last)


@query("str1_stream_audit", "SELECT CAST(ts AS DATE) AS dt, method, count(*) AS n FROM {v_audit} GROUP BY 1, 2")
def _(t):
    root = scratch_path(t.spark, "stream-audit")
    _done(audit_stream.stream_audit(_audit_stream(t), f"{root}/log", f"{root}/checkpoint"))
    # the sink's own log of finished files names a partition column of type string
    lines = t.spark.read.schema("value string, dt string").text(f"{root}/log")
    return parse_audit_lines(lines).groupBy(F.to_date("dt").alias("dt"), "method").agg(F.count("*").alias("n"))


@query("str2_stream_newest", "SELECT seq, action FROM {v_audit} ORDER BY ts DESC, seq DESC LIMIT 1000")
def _(t):
    root = scratch_path(t.spark, "stream-newest")
    _done(audit_stream.stream_newest(_audit_stream(t), f"{root}/newest", f"{root}/checkpoint"))
    return _last_snapshot(t, f"{root}/newest").select("seq", "action")


@query(
    "str3_stream_notify",
    """SELECT d.id AS triggered_document_id, p.manager_id AS receiver_id FROM {v_document} d JOIN {v_user} u ON u.id = d.uploader_id
       JOIN {v_department} p ON p.id = u.department_id WHERE p.manager_id IS NOT NULL AND p.manager_id <> u.id""",
)
def _(t):
    root = scratch_path(t.spark, "stream-notify")
    uploads = t.spark.sql(spark_sql_text(VIEWS["v_document"]), orders=_stream(t, "orders"), customer=t["customer"])
    out = notify_stream.stream_notify(uploads, t["v_user"], t["v_department"])
    _done(notify_stream.append_stream(out, f"{root}/out", f"{root}/checkpoint"))
    return t.spark.read.parquet(f"{root}/out").select("triggered_document_id", "receiver_id")


_KIND = "CASE event_type WHEN 'view' THEN 'processed' WHEN 'click' THEN 'failed' WHEN 'purchase' THEN 'preview_ready' WHEN 'error' THEN 'preview_failed' ELSE 'uploaded' END"


@query(
    "str4_stream_outcomes",
    """SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'AI processing complete for d' || CAST(event_id % 300 AS VARCHAR)
         WHEN 'click' THEN 'AI processing failed for d' || CAST(event_id % 300 AS VARCHAR) || ' -- try re-uploading'
         WHEN 'purchase' THEN 'Redacted preview ready: d' || CAST(event_id % 300 AS VARCHAR) ELSE 'Redacted preview failed: d' || CAST(event_id % 300 AS VARCHAR) END AS content
       FROM {events} e JOIN {v_user} u ON u.id = CAST(e.user_id AS VARCHAR) AND NOT u.is_deleted WHERE event_type <> 'signup'""",
)
def _(t):
    root = scratch_path(t.spark, "stream-outcomes")
    kind = F.expr(_KIND)
    events = _stream(t, "events").select(
        "event_id", (F.col("event_id") % 300).cast("string").alias("doc_id"), F.concat(F.lit("d"), (F.col("event_id") % 300).cast("string")).alias("doc_name"),
        kind.alias("kind"), F.col("user_id").cast("string").alias("user_id"),
    )
    out = notify_stream.stream_outcomes(events, t["v_user"])
    _done(notify_stream.append_stream(out, f"{root}/out", f"{root}/checkpoint"))
    return t.spark.read.parquet(f"{root}/out").select("id", "content")


_STATUS_KIND = """CASE event_id % 9 WHEN 0 THEN 'uploaded' WHEN 1 THEN 'processed' WHEN 2 THEN 'failed' WHEN 3 THEN 'preview_requested' WHEN 4 THEN 'preview_ready'
   WHEN 5 THEN 'preview_failed' WHEN 6 THEN 'preview_retry' WHEN 7 THEN 'preview_failed' ELSE 'processed' END"""
_STATUS = f"""SELECT doc_id, bool_or(kind = 'processed') AS ai_processed,
    coalesce(max(o) FILTER (WHERE kind = 'failed') > coalesce(max(o) FILTER (WHERE kind = 'processed'), -1), false) AS ai_processing_failed,
    CASE WHEN coalesce(max(o) FILTER (WHERE kind = 'failed') > coalesce(max(o) FILTER (WHERE kind = 'processed'), -1), false)
         THEN arg_max(reason, o) FILTER (WHERE kind = 'failed') END AS ai_failure_reason,
    CASE WHEN max(o) FILTER (WHERE kind IN ('preview_ready', 'preview_failed')) IS NULL
           THEN CASE WHEN bool_or(kind IN ('preview_requested', 'preview_retry')) THEN 'GENERATING' ELSE 'NOT_STARTED' END
         WHEN arg_max(kind, o) FILTER (WHERE kind IN ('preview_ready', 'preview_failed')) = 'preview_ready' THEN 'READY'
         WHEN max(o) FILTER (WHERE kind = 'preview_retry') > max(o) FILTER (WHERE kind = 'preview_failed') THEN 'GENERATING' ELSE 'FAILED' END AS redacted_preview_status
  FROM (SELECT CAST(event_id * 7 % 1013 AS VARCHAR) AS doc_id, {_STATUS_KIND} AS kind, 'reason ' || CAST(event_id AS VARCHAR) AS reason, row_number() OVER (ORDER BY ts, event_id) AS o FROM {{events}}) s GROUP BY doc_id"""


def _status_events(events: DataFrame) -> DataFrame:
    return events.select(
        "event_id", (F.col("event_id") * 7 % 1013).cast("string").alias("doc_id"), "ts", F.expr(_STATUS_KIND).alias("kind"),
        F.concat(F.lit("reason "), F.col("event_id").cast("string")).alias("reason"),
    )


@query("str5_stream_status", _STATUS)
def _(t):
    root = scratch_path(t.spark, "stream-status")
    _done(status_stream.stream_status(_status_events(_stream(t, "events")), f"{root}/status", f"{root}/checkpoint"))
    return _last_snapshot(t, f"{root}/status").select("doc_id", "ai_processed", "ai_processing_failed", "ai_failure_reason", "redacted_preview_status")


@query("str5_status_of_events", _STATUS)
def _(t):
    return status_stream.status_of(_status_events(t["events"])).select("doc_id", "ai_processed", "ai_processing_failed", "ai_failure_reason", "redacted_preview_status")


_STUCK = """SELECT CAST(u.event_id // 5 AS VARCHAR) AS doc_id, u.ts AS uploaded_at FROM {events} u
   WHERE u.event_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM {events} o WHERE o.event_id % 5 <> 0
     AND o.event_type IN ('view', 'click') AND o.event_id // 5 = u.event_id // 5 AND o.ts >= u.ts AND o.ts <= u.ts + INTERVAL 200 SECOND)"""


def _uploads_and_outcomes(events: DataFrame):
    doc = F.expr("CAST(event_id div 5 AS STRING)").alias("doc_id")
    ups = events.filter("event_id % 5 = 0").select(doc, F.col("ts").cast("timestamp").alias("uploaded_at"))
    outs = events.filter("event_id % 5 <> 0 AND event_type IN ('view', 'click')").select(doc, F.col("ts").cast("timestamp").alias("finished_at"))
    return ups, outs


@query("str6_stream_stuck", _STUCK)
def _(t):
    root = scratch_path(t.spark, "stream-stuck")
    # a later upload and outcome end the log: they move the watermark past every deadline
    last = t["events"].agg(F.max("ts").alias("ts")).withColumn("ts", F.col("ts") + F.expr("interval 1 day"))
    closing = last.select(F.explode(F.array(F.lit(-10).cast("long"), F.lit(-9).cast("long"))).alias("event_id"), "ts", F.lit("view").alias("event_type"))
    t["events"].select("event_id", "ts", "event_type").unionByName(closing).write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema(t.spark.read.parquet(f"{root}/in").schema).parquet(f"{root}/in")
    out = status_stream.stream_stuck(*_uploads_and_outcomes(stream))
    _done(notify_stream.append_stream(out, f"{root}/out", f"{root}/checkpoint"))
    found = t.spark.read.parquet(f"{root}/out").filter("doc_id <> '-2'")
    return found.select("doc_id", F.col("uploaded_at").cast("timestamp_ntz").alias("uploaded_at"))


@query(
    "str6_stuck_in_stored_events",
    """SELECT CAST(u.event_id // 5 AS VARCHAR) AS doc_id, u.ts AS uploaded_at, d.limit_s FROM {events} u, (SELECT CAST(180 AS INT) AS limit_s UNION ALL SELECT 200 UNION ALL SELECT 600) d
       WHERE u.event_id % 5 = 0 AND NOT EXISTS (SELECT 1 FROM {events} o WHERE o.event_id % 5 <> 0 AND o.event_type IN ('view', 'click')
         AND o.event_id // 5 = u.event_id // 5 AND o.ts >= u.ts AND o.ts <= u.ts + to_seconds(d.limit_s))""",
)
def _(t):
    # a log that is complete: every upload is settled, for the service's and the clients' deadlines
    limits = (V.CLIENT_DEADLINES[0], V.EXPECTED_SECONDS, V.CLIENT_DEADLINES[1])
    found = [status_stream.stream_stuck(*_uploads_and_outcomes(t["events"]), limit_s=n).withColumn("limit_s", F.lit(n)) for n in limits]
    return reduce(DataFrame.unionByName, found).select("doc_id", F.col("uploaded_at").cast("timestamp_ntz").alias("uploaded_at"), "limit_s")


@query(
    "str7_stream_unread",
    """SELECT n.receiver_id, count(*) FILTER (WHERE NOT n.has_read AND m.id IS NULL) AS unread FROM {v_notification} n
       LEFT JOIN (SELECT DISTINCT 'n' || CAST(event_id AS VARCHAR) AS id, CAST(user_id % 40 AS VARCHAR) AS actor FROM {events}) m ON m.id = n.id AND m.actor = n.receiver_id GROUP BY 1""",
)
def _(t):
    root = scratch_path(t.spark, "stream-unread")
    marks = _stream(t, "events").select(
        F.concat(F.lit("n"), F.col("event_id").cast("string")).alias("notification_id"), (F.col("user_id") % 40).cast("string").alias("actor_id")
    )
    valid = notify_stream.valid_marks(marks, t["v_notification"])
    _done(notify_stream.append_stream(valid, f"{root}/marks", f"{root}/checkpoint"))
    return notify_stream.unread(t["v_notification"], t.spark.read.parquet(f"{root}/marks"))


@query("str8_throttled_dead_letters", "SELECT event_type = 'error' AS failed, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM {events} GROUP BY 1")
def _(t):
    root = scratch_path(t.spark, "stream-throttled")
    t["events"].select("event_id", "event_type").repartition(6).write.json(f"{root}/in")
    source = audit_stream.throttled(t.spark, f"{root}/in", "event_id bigint, event_type string", max_files=2)
    work = source.withColumn("error", F.when(F.col("event_type") == "error", "could not be processed"))
    _done(audit_stream.write_with_dead_letters(work, f"{root}/ok", f"{root}/dead", f"{root}/checkpoint"))
    ok = t.spark.read.parquet(f"{root}/ok").select("event_id", F.lit(False).alias("failed"))
    dead = t.spark.read.parquet(f"{root}/dead").select("event_id", F.lit(True).alias("failed"))
    return ok.unionByName(dead).groupBy("failed").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))
