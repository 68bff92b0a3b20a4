"""Broadcast only what has been measured."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of a plan; files are measured, filters only lower it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame) -> DataFrame:
    """Hint a broadcast when the estimated size is under the session's broadcast threshold;
    otherwise leave the join to the optimizer, which shuffles and, under AQE, splits skewed keys."""
    limit = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return F.broadcast(df) if plan_bytes(df) <= limit else df
