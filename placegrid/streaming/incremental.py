"""Incremental forms: annotation documents as a file stream, and the request-rate audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def increments(spark: SparkSession, folder: str, schema: StructType | str, files: int | None = None) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files) if files else reader).parquet(folder)


def drained(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there and stop; the checkpoint makes the next call take only what is new."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def rate_audit(calls: DataFrame, ts: str, limit: int, window: str = "60 seconds") -> DataFrame:
    """window_start, calls, over: calls by window and whether they exceed the limit. Works on streams with a watermark."""
    counted = calls.groupBy(F.window(ts, window).alias("w")).agg(F.count(F.lit(1)).alias("calls"))
    return counted.select(F.col("w.start").alias("window_start"), "calls", (F.col("calls") > limit).alias("over"))


def micros(ts: str) -> Column:
    """Microseconds of a time stamp with or without zone (then read in the session's, which should have no leaps: UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def spacing(calls: DataFrame, ts: str, key: str, limit: int) -> DataFrame:
    """key, ts, gap_s, early of each call: seconds since the key's call before, and whether they are less than 60 / limit."""
    order = Window.partitionBy(key).orderBy(ts)
    gap = micros(ts) - F.lag(micros(ts)).over(order)
    return calls.select(key, ts, (gap / 1e6).alias("gap_s"), F.coalesce(gap < F.lit(60_000_000 // limit), F.lit(False)).alias("early"))


def paced(requests: DataFrame, ts: str, key: str, limit: int) -> DataFrame:
    """key, ts, start: when a limiter of ``limit`` calls a minute (least spacing 60 / limit) lets each key's requests start.

    With a constant spacing s the nth start is the latest of ts_i + (n - i) s over i up to n, which is a running maximum.
    The spacing alone holds a minute's calls to the limit.
    """
    step = 60_000_000 // limit
    order = Window.partitionBy(key).orderBy(ts)
    rows = requests.withColumn("_n", F.row_number().over(order).cast("long"))
    free = F.max(micros(ts) - F.col("_n") * step).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, ts, F.timestamp_micros(free + F.col("_n") * step).cast(requests.schema[ts].dataType).alias("start"))
