"""A resumable map over a stream of items: every batch enters the ledger once, and what failed comes back.

New items arrive as a stream. Each micro-batch runs the work on the items that have not succeeded yet, writes the attempts
into a folder of its own and publishes them under the batch's number, by a rename. The stream commits its offsets
afterwards; if the process dies in between, the batch is replayed under the same number, finds itself published and writes
nothing, and if it dies before publishing, the folder that it left is never read. Each run begins with the items whose last
attempt failed, as a batch numbered by the runs so far.

Each publication is a small file that names its folder, so the ledger is the union of the published folders; ``compacted``
folds them into one generation of ``generations``.

Nulls and edges: a null item is left out; an item that arrives again, in any batch, is not worked on again once it has
succeeded; items that a batch holds twice are worked on once; without new items a run only retries.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placegrid.operators.generations import Generation, listed, published, read_text, saved
from placegrid.operators.ledger import attempted, latest

ATTEMPTS = "item string, status string, result string, error string, attempt int"


def folders(spark: SparkSession, base: str) -> list[str]:
    """The folders of the published batches; one small file a batch is read."""
    names = sorted(n for n in listed(spark, f"{base}/batches") if n.endswith(".json"))
    return [f"{base}/{json.loads(read_text(spark, f'{base}/batches/{n}'))['folder']}" for n in names]


def attempts(spark: SparkSession, base: str) -> DataFrame:
    """All published attempts: item, status, result, error, attempt."""
    found = folders(spark, base)
    return spark.read.schema(ATTEMPTS).parquet(*found) if found else spark.createDataFrame([], ATTEMPTS)


def worked(items: DataFrame, base: str, batch: str, work: Callable[[str], str], tries: int = 1) -> bool:
    """Work on the items of a batch that have not succeeded, and publish it; False if it was published before."""
    spark, mark = items.sparkSession, f"{base}/batches/{batch}.json"
    if f"{batch}.json" in listed(spark, f"{base}/batches"):
        return False
    before = latest(attempts(spark, base)).select("item", "status", F.col("attempt").alias("tried"))
    todo = items.select(F.col("item").cast("string").alias("item")).where("item is not null").distinct().join(before, "item", "left").where("status is null or status <> 'success'")
    folder = f"attempts-{uuid.uuid4().hex}"
    attempted(todo.select("item", (F.coalesce("tried", F.lit(0)) + 1).alias("attempt")), work, tries=tries).write.mode("errorifexists").parquet(f"{base}/{folder}")
    return published(spark, mark, json.dumps({"folder": folder, "batch": batch}))


def resumed(stream: DataFrame, base: str, checkpoint: str, work: Callable[[str], str], tries: int = 1) -> DataFrame:
    """Retry what failed last, work on all items that have arrived on ``stream`` (column item), and give the attempts."""
    spark = stream.sparkSession
    failed = latest(attempts(spark, base)).where("status <> 'success'").select("item")
    runs = sum(n.startswith("retry-") for n in listed(spark, f"{base}/batches"))
    if not failed.isEmpty():
        worked(failed, base, f"retry-{runs:06d}", work, tries)

    def batch(items: DataFrame, number: int) -> None:
        worked(items, base, f"batch-{number:09d}", work, tries)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return attempts(spark, base)


def compacted(spark: SparkSession, base: str, to: str) -> Generation:
    """The last attempt of each item as the next generation of the ledger at ``to``."""
    return saved(latest(attempts(spark, base)), to, batches=len(folders(spark, base)))
