"""The audit log: JSON lines, one folder per day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "timestamp timestamp_ntz, user_id string, name string, email string, role string, method string, "
    "path string, action string, status int, duration_ms bigint, client_ip string, error string"
)


def parse_audit_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries from JSON lines; blank and corrupt lines are skipped (SRC6). Other columns
    of ``lines`` are kept."""
    text = F.col(column)
    entry = F.from_json(text, f"{ENTRY}, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    kept = [c for c in lines.columns if c != column]
    return (
        lines.filter(F.trim(text) != "")
        .select(*kept, entry.alias("e"))
        .filter(F.col("e").isNotNull() & F.col("e._corrupt_record").isNull())
        .select(*kept, "e.*")
        .drop("_corrupt_record")
        .withColumnRenamed("timestamp", "ts")
    )


def read_audit(spark: SparkSession, root: str, date: str | None = None) -> DataFrame:
    """Entries of one day or of all days (SRC6). A day without entries is empty; the day
    filter prunes folders. ``seq`` orders entries by their place in the files."""
    lines = spark.read.schema("value string, dt date").option("recursiveFileLookup", "false").text(root)
    if date is not None:
        lines = lines.filter(F.col("dt") == F.lit(date).cast("date"))
    placed = lines.select(
        "dt",
        F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_name"), F.col("_metadata.file_block_start")).alias("seq"),
        "value",
    )
    return parse_audit_lines(placed)


def to_lines(entries: DataFrame) -> DataFrame:
    """``dt, value``: entries as JSON lines with their day (SNK1)."""
    names = [c.split()[0] for c in ENTRY.split(", ")]
    fields = [F.col("ts").alias("timestamp") if n == "timestamp" else F.col(n) for n in names]
    return entries.select(F.to_date("ts").alias("dt"), F.to_json(F.struct(*fields)).alias("value"))


def append_audit(entries: DataFrame, root: str) -> None:
    """Append entries to their days (SNK1). Rows are clustered by day first: a quiet day is one
    file, a busy one is split into parts of the size that the session advises."""
    to_lines(entries).hint("rebalance", "dt").write.mode("append").partitionBy("dt").text(root)
