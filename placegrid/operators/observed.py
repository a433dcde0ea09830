"""Counts and sums of a run taken by the pass that does the work, instead of a second one over what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


USAGE = ("prompt_tokens", "completion_tokens", "thinking_tokens", "total_tokens", "api_calls")


def written_with_usage(rows: DataFrame, path: str, usage: tuple[str, ...] = USAGE, mode: str = "errorifexists") -> dict[str, int]:
    """Write attempts (status and usage columns) as Parquet; rows, failed and the sums of usage, taken on the way.

    Spark counts a task's metrics once, when it succeeds, so attempts that were lost or ran twice do not show. A NULL
    status counts as failed, a NULL number as nothing; an empty table gives zeros.
    """
    seen = Observation()
    sums = [F.coalesce(F.sum(u), F.lit(0)).alias(u) for u in usage]
    failed = F.count_if(F.coalesce(F.col("status") != "success", F.lit(True))).alias("failed")
    rows.observe(seen, F.count(F.lit(1)).alias("rows"), failed, *sums).write.mode(mode).parquet(path)
    return {k: int(v) for k, v in seen.get.items()}


def checked_copy(features: DataFrame, path: str, expected: int, mode: str = "errorifexists") -> dict[str, int | bool]:
    """Consolidate a feature table and say whether it is complete: expected and found rows, complete, by the same pass."""
    seen = Observation()
    features.observe(seen, F.count(F.lit(1)).alias("found")).write.mode(mode).parquet(path)
    found = int(seen.get["found"])
    return {"expected": expected, "found": found, "complete": found == expected}
