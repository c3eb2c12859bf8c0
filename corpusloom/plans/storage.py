"""Intermediate tables in the folder that all executors share.

A written table cuts the lineage and survives the loss of executors. The folder is spark.checkpoint.dir where the session
names one; only a session on one machine may leave it unset (tests), and then gets a temporary folder.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; an error on a cluster that names none, as no local folder is seen by all workers."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all workers share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="corpusloom-"))
    return _OWN[0]


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; what is written there goes when the session ends."""
    path = f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def materialise(df: DataFrame, name: str = "table") -> DataFrame:
    """Write df to the shared folder and return the written table; the files go when the session ends."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


def discard(*tables: DataFrame, spark: SparkSession | None = None) -> None:
    """Delete the files of written tables that nothing will read again, and the shuffle files of ended jobs.

    Spark removes shuffle files when the driver's JVM collects what refers to them, which else may be never.
    """
    for t in tables:
        spark = t.sparkSession
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(t._written_at)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if spark is not None:
        gc.collect()
        spark.sparkContext._jvm.System.gc()
