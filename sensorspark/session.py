"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime re-planning does the size-checked broadcasts and splits skewed join partitions.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def configure(builder: SparkSession.Builder, **extra: str) -> SparkSession.Builder:
    for key, value in {**RECOMMENDED, **extra}.items():
        builder = builder.config(key, value)
    return builder


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder. Where the session names none, a run in one process gets a folder of
    its own; on a cluster that is an error, as executors would not see each other's files."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sensorspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark).rstrip('/')}/sensorspark/{label}-{uuid.uuid4().hex}"


def via_table(df: DataFrame, label: str) -> DataFrame:
    """Write a frame that several jobs read, and read it back: lineage ends at files that outlive
    any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored._stored_at = path
    return stored


def stored_bytes(table: DataFrame) -> int:
    """The size of a table of ``via_table`` as its files have it."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
    system = path.getFileSystem(table._jdf.sparkSession().sessionState().newHadoopConf())
    return system.getContentSummary(path).getLength()


def forget(*tables: DataFrame) -> None:
    """Delete tables of ``via_table`` that nothing reads any more."""
    for table in tables:
        state = table._jdf.sparkSession().sessionState()
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._stored_at)
        path.getFileSystem(state.newHadoopConf()).delete(path, True)
