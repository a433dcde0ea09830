"""Tables between the steps of a job, in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders that this process has made and not deleted yet.
_made: set[str] = set()


def folder(spark: SparkSession) -> str:
    """A new folder name under ``spark.checkpoint.dir``; a local one only on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='placegrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/placegrid/{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made.add(path)
    return path


def deleted(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made.discard(path)


def written(df: DataFrame) -> DataFrame:
    """``df`` as Parquet, read back: cuts lineage and survives lost executors."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for these, once nothing reads it any more."""
    for t in tables:
        if path := t.__dict__.get("_scratch"):
            deleted(t.sparkSession, path)


def release(spark: SparkSession | None = None) -> None:
    """Delete all scratch folders; runs at the end of the process."""
    spark = spark or SparkSession.getActiveSession()
    if spark and spark.sparkContext._jsc:
        for path in list(_made):
            deleted(spark, path)
