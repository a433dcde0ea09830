"""Resumable batches as set operations over ledgers of items."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from placegrid.functions.paths import stem
from placegrid.operators.generations import listed
from placegrid.operators.positions import batched, numbered


def pending(items: DataFrame, done: DataFrame, key: str = "item") -> DataFrame:
    """Items that are not done yet."""
    return items.join(done.select(key).distinct(), key, "left_anti")


def latest(ledger: DataFrame, key: str = "item", order: str = "attempt") -> DataFrame:
    """The last row of each item: last write wins, and of rows with equal ``order`` the one that is least as JSON.

    ``order``: numbers or time stamps; a NULL is before all others. One aggregation, with partial ones before the shuffle,
    so that an item with very many attempts is no hot key.
    """
    at = F.col(order) if isinstance(ledger.schema[order].dataType, NumericType) else F.unix_micros(F.col(order).cast("timestamp"))
    first = F.struct(at.isNull().alias("n"), (-at).alias("o"), F.to_json(F.struct("*")).alias("j"))
    return ledger.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct("*"), first).alias("w")).select("w.*")


def to_retry(items: DataFrame, ledger: DataFrame, key: str = "item") -> DataFrame:
    """Items whose latest status is not success, and those never tried."""
    good = latest(ledger, key).where("status = 'success'")
    return pending(items, good, key)


def outputs_done(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """Items with a generated file: output names are <stem>_generated_<number>.<suffix>, matched by their stem exactly."""
    made = outputs.select(F.regexp_extract("output", r"^(.*)_generated_[0-9]+\.[^.]*$", 1).alias("stem")).where("stem <> ''").distinct()
    return items.withColumn("stem", stem(F.col("item"))).join(made, "stem", "left_semi").drop("stem")


def attempted(items: DataFrame, work: Callable[[str], str], attempt: int = 1, tries: int = 1) -> DataFrame:
    """item, status, result, error, attempt: ``work`` on every item; an item's failure is recorded in its row alone.

    Items may bring the number of their attempt as a column ``attempt``.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for item, number in zip(b["item"], b["attempt"], strict=True):
                for left in range(tries - 1, -1, -1):
                    try:
                        rows.append((item, "success", work(item), None, number))
                        break
                    except Exception as e:  # noqa: BLE001  user code: recorded, retried, never fatal
                        if not left:
                            rows.append((item, "failed", None, repr(e), number))
            yield pd.DataFrame(rows, columns=["item", "status", "result", "error", "attempt"])

    number = F.col("attempt") if "attempt" in items.columns else F.lit(attempt)
    return items.select(F.col("item").cast("string"), number.cast("int").alias("attempt")).mapInPandas(run, "item string, status string, result string, error string, attempt int")


def shard_completeness(expected: DataFrame, found: DataFrame) -> DataFrame:
    """One row: expected, found, missing, corrupt shards and the share that is complete. found: shard, rows (0: corrupt)."""
    rows = expected.join(found, "shard", "left")
    return rows.agg(F.count(F.lit(1)).alias("expected"), F.count_if(F.col("rows") > 0).alias("found"), F.count_if(F.col("rows").isNull()).alias("missing"), F.count_if(F.col("rows") == 0).alias("corrupt")).withColumn("rate", F.try_divide("found", "expected"))


def ranked(items: DataFrame, key: str, ranges: int | None = None) -> DataFrame:
    """Adds position (from 0) in the order of a key of any type (see ``positions``)."""
    return numbered(items, key, ranges=ranges)


def batches(items: DataFrame, key: str, size: int) -> DataFrame:
    """Consecutive batches of ``size`` in the order of a key of any type, numbered from 0 and zero-padded."""
    return batched(items, key, size=size)


def usage(rows: DataFrame, by: str) -> DataFrame:
    """Token usage summed by a key."""
    names = ("prompt_tokens", "completion_tokens", "thinking_tokens", "total_tokens", "api_calls")
    return rows.groupBy(by).agg(*[F.sum(n).alias(n) for n in names])


def with_output(items: DataFrame, outputs: DataFrame, suffix: str = ".json") -> DataFrame:
    """Items whose output file <stem><suffix> is there: what a checkpoint is rebuilt from."""
    made = outputs.select(F.col("output").alias("_o")).distinct()
    return items.withColumn("_o", F.concat(stem(F.col("item")), F.lit(suffix))).join(made, "_o", "left_semi").drop("_o")


def keyed_in(items: DataFrame, results: DataFrame) -> DataFrame:
    """Items that are keys of a result map (rows with a column ``results`` of type map)."""
    return items.join(results.select(F.explode(F.map_keys("results")).alias("item")).distinct(), "item", "left_semi")


def rerank_tasks(items: DataFrame, retrieval: DataFrame, done: DataFrame, root: str, most: int = 100) -> DataFrame:
    """item, candidates: for items with a first result and no answer yet, paths of the first ``most`` targets in rank order.

    An item whose list is empty is an error.
    """
    open_items = items.join(retrieval.select(F.col("query").alias("item")).distinct(), "item", "left_semi").join(done.select("item").distinct(), "item", "left_anti")
    ranked_ = retrieval.where(F.col("rank") <= most).groupBy(F.col("query").alias("item")).agg(F.array_compact(F.transform(F.array_sort(F.collect_list(F.struct("rank", "target"))), lambda t: t["target"])).alias("t"))
    paths = F.transform("t", lambda t: F.concat(F.lit(root.rstrip("/") + "/"), t))
    rows = open_items.join(ranked_, "item", "left")
    return rows.select("item", F.when(F.size("t") > 0, paths).otherwise(F.raise_error(F.concat(F.lit("no candidates for "), F.col("item")))).alias("candidates"))


def status_counts(ledger: DataFrame) -> DataFrame:
    """One row: succeeded and failed items."""
    return ledger.agg(F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.coalesce(F.col("status") != "success", F.lit(True))).alias("failed"))


def size_plan(shards: DataFrame, single_gb: float = 6.0, chunk_gb: float = 5.0) -> DataFrame:
    """One row: shards, gib, strategy (single or chunked), chunks and shards_per_chunk of a consolidation (shards: bytes)."""
    rows = shards.agg(F.count(F.lit(1)).alias("shards"), (F.coalesce(F.sum("bytes"), F.lit(0)) / F.lit(float(1 << 30))).alias("gib"))
    chunks = F.greatest(F.lit(1), F.floor(F.col("gib") / chunk_gb))
    return rows.withColumn("strategy", F.when(F.col("gib") > single_gb, "chunked").otherwise("single")).withColumn("chunks", F.when(F.col("gib") > single_gb, chunks).otherwise(F.lit(1))).withColumn(
        "shards_per_chunk", F.greatest(F.lit(1), F.floor(F.col("shards") / F.col("chunks")))
    )


def chunk_ranges(shards: DataFrame, chunks: int) -> DataFrame:
    """chunk, first, last, n: consecutive ranges of distinct integer ``shard`` numbers; the last one takes what is left over."""
    rows = ranked(shards.select("shard"), "shard")
    per = F.greatest(F.lit(1), F.floor(F.lit(rows.count()) / chunks))
    chunk = F.least(F.floor(F.col("position") / per), F.lit(chunks - 1))
    return rows.groupBy(chunk.alias("chunk")).agg(F.min("shard").alias("first"), F.max("shard").alias("last"), F.count(F.lit(1)).alias("n"))


def chunk_size(shards: int, memory_gib: float, feature_bytes: int = 2048, features: int = 64, share: float = 0.4) -> int:
    """Shards that may be in memory at once: a share of the memory, at most all, at least one."""
    return int(min(max(1, memory_gib * (1 << 30) * share // feature_bytes // features), shards))


def missing_shards(expected: DataFrame, found: DataFrame) -> DataFrame:
    """shard, reason (missing or corrupt) of the shards to make again. found: shard, rows (0: corrupt)."""
    rows = expected.join(found, "shard", "left")
    return rows.select("shard", F.when(F.col("rows").isNull(), "missing").when(F.col("rows") == 0, "corrupt").alias("reason")).where("reason is not null")


def to_extract(paths: DataFrame, cached: DataFrame) -> DataFrame:
    """Paths without a cached feature row: all that a feature cache does not have, instead of all if counts differ."""
    return paths.join(cached.select("path").distinct(), "path", "left_anti")


def verified(features: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: expected and found rows of a consolidated feature table, and whether they match."""
    counts = features.agg(F.count(F.lit(1)).alias("found")).crossJoin(expected.agg(F.count(F.lit(1)).alias("expected")))  # one row each
    return counts.select("expected", "found", (F.col("expected") == F.col("found")).alias("complete"))


def checkpoint_info(ledger: DataFrame) -> DataFrame:
    """One row: attempts, items, processed (latest status success), failed, last attempt."""
    now = latest(ledger)
    ends = ledger.agg(F.count(F.lit(1)).alias("attempts"), F.max("attempt").alias("last_attempt"))
    return ends.crossJoin(now.agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("status") == "success").alias("processed"), F.count_if(F.coalesce(F.col("status") != "success", F.lit(True))).alias("failed")))


def checkpoint(spark: SparkSession, main: str, backup: str, schema: str) -> DataFrame:
    """The ledger at ``main``; the backup if the main one is there but not all of it can be read; empty if there is no main one.

    All files are read, so one that is cut short is noticed. If neither can be read it fails: an empty ledger would have
    all work done again. ``generations`` keeps ledgers that can also tell a lost file.
    """
    failed: Exception | None = None
    for path in (main, backup):
        rows = spark.read.schema(schema)
        try:
            found = rows.parquet(path)
            found.select(F.sum(F.xxhash64(F.to_json(F.struct("*"))).bitwiseAND(F.lit(1)))).collect()
            return found
        except (PySparkException, Py4JJavaError) as e:
            if "PATH_NOT_FOUND" in str(e):
                break
            failed = e
    if failed:
        raise failed
    return spark.createDataFrame([], schema)


def cached(spark: SparkSession, base: str, parameters: dict[str, object], make: Callable[[], DataFrame]) -> DataFrame:
    """A result under a folder named by all its parameters (and what it was made from), made only if it is not there.

    A folder without the mark of a finished write is what a failed one left, and is written again.
    """
    name = hashlib.sha256(json.dumps(parameters, sort_keys=True, default=str).encode()).hexdigest()[:24]
    path = f"{base.rstrip('/')}/{name}"
    if "_SUCCESS" not in listed(spark, path):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
