"""Helpers that the corpus operators share: scratch tables, Arrow mapping, word splitting.

Words are maximal runs of anything but ASCII white space (``[^\\x20\\x09-\\x0D]+``). On UTF-8 bytes
``bytes.split()`` yields exactly these, so texts travel as binary columns and are never decoded where
bytes will do.
"""

from __future__ import annotations

import atexit
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows per Arrow batch; texts of some 100 KB occur, so batches stay small.
ARROW_ROWS = 400


def tune(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for texts, and let a table bucketed by some of a join's keys stay where it is."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


#: Folders and tables that this process has made and not deleted yet.
_made: dict[str, str] = {}


def scratch(spark: SparkSession) -> str:
    """A new folder name under the cluster's shared ``spark.checkpoint.dir``; a local one only on a local master (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='placegrid-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/placegrid/{uuid.uuid4().hex}"
    if not _made:
        atexit.register(release)
    _made[path] = ""
    return path


def table_name(spark: SparkSession) -> tuple[str, str]:
    """Name and folder of a new table."""
    path = scratch(spark)
    _made[path] = f"placegrid_{uuid.uuid4().hex}"
    return _made[path], path


def written(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", codec).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def deleted(spark: SparkSession, path: str) -> None:
    if name := _made.pop(path, ""):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Delete what ``written`` wrote for these, once nothing reads it any more."""
    for t in tables:
        if path := t.__dict__.get("_scratch"):
            deleted(t.sparkSession, path)


def release(spark: SparkSession | None = None) -> None:
    """Delete all scratch folders and tables; results that were not written elsewhere cannot be read after it.

    Runs at the end of the process; a long session calls it between jobs.
    """
    spark = spark or SparkSession.getActiveSession()
    if spark and spark.sparkContext._jsc:
        for path in list(_made):
            deleted(spark, path)


def partitions(df: DataFrame, per_bytes: int = 16 << 20) -> int:
    """Shuffle partitions in proportion to the planner's size of ``df``, at least the session's setting."""
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > 1 << 60 else max(least, -(-size // per_bytes))


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id and the whole text as bytes (null: null), with further columns; others are pruned from the scan."""
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"), *more)


def mapped(df: DataFrame, fn: Callable[[dict], dict], schema: str) -> DataFrame:
    """Apply ``fn`` (columns as lists -> columns as lists or arrays) to each Arrow batch; a pure map, no shuffle."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn({n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, schema)


def extended(df: DataFrame, fn: Callable[[list], dict], schema: str, column: str = "text") -> DataFrame:
    """All columns of ``df`` passed through, with those that ``fn`` computes from ``column`` (as bytes) appended."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    more = _parse_datatype_string(schema)
    whole = StructType([*df.schema.fields, *more.fields])
    arrow, added, at = to_arrow_schema(whole), to_arrow_schema(more), df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                out = fn(b.column(at).cast(pa.binary()).to_pylist())
                columns = [c.cast(f.type) for c, f in zip(b.columns, arrow, strict=False)]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(out[f.name], f.type) for f in added)], schema=arrow)

    return df.mapInArrow(run, whole)


#: A key with more rows than this, and with more than a thousandth of all, is heavy; so at most a thousand are.
HEAVY = 20_000


def salted_join(rows: DataFrame, small: DataFrame, key: str, salt_of: str, how: str = "left", heavy: int = HEAVY) -> DataFrame:
    """Join where ``rows`` may hold hot keys. ``small`` is a written table with one row a key and ``n``, its rows in ``rows``.

    Only the rows of heavy keys are dealt over salts, and only their counterparts are repeated; ``n`` is not returned.
    """
    total = small.agg(F.sum("n")).first()[0] or 0
    hot = {r[key]: -(-r["n"] // heavy) for r in small.where(F.col("n") > max(heavy, total // 1000)).select(key, "n").collect()}  # at most 1000
    if not hot:
        return rows.join(small.drop("n"), key, how)
    salts = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in hot.items() for x in kv]), F.col(key)), F.lit(1))
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(salt_of), salts).cast("int"))
    right = small.drop("n").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts.cast("int") - 1)))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def trim() -> None:
    """Give freed memory back to the system, where the C library can; large arrays otherwise linger in the worker."""
    if sys.platform == "linux":
        release = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if release:
            release(0)


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (xor-shift and multiply), vectorised and invertible."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))
