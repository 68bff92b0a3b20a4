"""Audit queries over entries ``ts, seq, user_id, name, email, role, method, path, action,
status, duration_ms, client_ip, error`` (plus ``dt`` when read from the day-partitioned
log)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from .listing import clamp_limit


def query_audit(
    audit: DataFrame,
    user_id: str | None = None,
    method: str | None = None,
    path: str | None = None,
    date: dt.date | str | None = None,
    limit: int = 200,
) -> DataFrame:
    """Entries matching all given filters, newest first (FIL5). A day filter prunes the
    day partitions of the log."""
    out = audit
    if date is not None:
        day = F.lit(str(date)).cast("date")
        out = out.filter(F.col("dt") == day) if "dt" in audit.columns else out.filter(F.to_date("ts") == day)
    if user_id is not None:
        out = out.filter(F.col("user_id") == user_id)
    if method is not None:
        out = out.filter(F.upper("method") == method.upper())
    if path is not None:
        out = out.filter(F.col("path").contains(path))
    return out.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(clamp_limit(limit))


def audit_stats(audit: DataFrame) -> DataFrame:
    """Entries held by the newest-n buffer, and its capacity (AGG9)."""
    return audit.agg(
        F.least(F.count("*"), F.lit(V.AUDIT_CAPACITY)).alias("held"), F.lit(V.AUDIT_CAPACITY).alias("capacity")
    )
