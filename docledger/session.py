"""Session settings and lineage cuts."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .operators.broadcasting import plan_bytes

_SPLIT_BYTES = 64 * 1024 * 1024

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # text work is CPU-bound: do not merge small partitions down to a single task
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # building large expressions is faster without a call-site record for each part
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    # documents differ in size by four orders of magnitude: keep input splits small
    "spark.sql.files.maxPartitionBytes": "64m",
}


def local_session(cores: int | str = 8, memory: str = "12g", **extra: str) -> SparkSession:
    """A single-machine session for tests and the bench; on a cluster pass your own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("docledger")
    conf = {
        **SETTINGS,
        "spark.driver.memory": memory,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        **extra,
    }
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def spread(df: DataFrame) -> DataFrame:
    """Give CPU-heavy work on a small stored table all cores. Decided from the plan's size
    estimate, so nothing runs; a table too large for one split per core is left alone."""
    # on a cluster of many cores the scan is split instead: at most 32 splits are dealt out
    cores = min(df.sparkSession.sparkContext.defaultParallelism, 32)
    return df.repartition(cores) if plan_bytes(df) < cores * _SPLIT_BYTES else df


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table and read it from there: several uses do not recompute
    it, later steps read only the columns they need, and a lost executor loses nothing.

    ``checkpoint()`` would compute the plan twice (once to run it, once to save it)."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder for written results below the session's shared checkpoint folder. The
    folder is deleted when the driver's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(jvm_path)
    return path


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share. Only a session whose executors live in
    the driver's own process may do without the setting; it gets a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="docledger-")
    spark.conf.set("spark.checkpoint.dir", base)
    return base
