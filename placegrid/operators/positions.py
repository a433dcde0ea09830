"""Positions in an order of any keys, without a window or a task that holds all rows.

Boundaries are sampled, rows go to ranges of the keys and are sorted there; a row's number within its range and the
ranges' sizes, one number a range, give its position. Any columns serve as keys: paths, sparse or repeated numbers. Rows
that are equal in all keys get neighbouring positions in no stated order; a random number, drawn before the exchange,
lets even a key that most rows share go to many ranges.

Nulls and edges: null keys come first; repeated rows get a position each; an empty table gives no rows; columns of any
names pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placegrid.scratch import written

#: Bytes of a range, about.
RANGE_BYTES = 32 << 20
#: Bits of a row's number within its range, as ``monotonically_increasing_id`` has it.
BITS = 33


def range_count(rows: DataFrame) -> int:
    """Ranges in proportion to the planner's size of the rows, at least as many as the session shuffles to."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return least if size > 1 << 60 else max(least, -(-size // RANGE_BYTES))


def numbered(rows: DataFrame, *order: str, ranges: int | None = None, name: str = "position") -> DataFrame:
    """Adds the position (from 0) in ascending order of the columns ``order``; rests on a written table."""
    names = [f"c{i}" for i in range(len(rows.columns))]  # whatever the columns are called, none clashes
    keys = [names[rows.columns.index(c)] for c in order]
    spread = rows.toDF(*names).withColumn("r", F.rand(3))
    dealt = spread.repartitionByRange(ranges or range_count(rows), *keys, "r").sortWithinPartitions(*keys, "r").drop("r")
    kept = written(dealt.withColumn("m", F.monotonically_increasing_id()))
    sizes = kept.groupBy(F.shiftrightunsigned("m", BITS).alias("range")).agg(F.count(F.lit(1)).alias("n"))  # a row a range
    before = F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    first = sizes.select("range", F.coalesce(before, F.lit(0)).alias("first"))
    found = kept.withColumn("range", F.shiftrightunsigned("m", BITS)).join(F.broadcast(first), "range")  # a number a range
    position = F.col("first") + F.col("m").bitwiseAND(F.lit((1 << BITS) - 1))
    return found.select(*names, position.alias("p")).toDF(*rows.columns, name)


def batched(rows: DataFrame, *order: str, size: int, name: str = "batch") -> DataFrame:
    """Adds the number (from 0, padded to six digits) of the consecutive batch of ``size`` rows that each row falls into."""
    out = numbered(rows, *order, name="_position")
    return out.withColumn(name, F.lpad(F.floor(F.col("_position") / size).cast("string"), 6, "0")).drop("_position")
