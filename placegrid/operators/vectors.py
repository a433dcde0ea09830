"""Vector search and pooling on arrays.

Exact k-nearest-neighbour search is in ``search``. Rows without a vector, or with a NULL or NaN in it, are neither queries
nor references there; ``unusable`` reports them, and those of another length than a stated size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from placegrid.operators.search import knn, knn_within, top_k

__all__ = ["expanded", "knn", "knn_within", "l2_normalized", "pooled", "projected", "rerank", "squared_l2", "top_k", "unusable"]

EPS, POWER = 1e-6, 3.0


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def l2_normalized(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm > 1e-12, norm).otherwise(F.lit(1e-12)))


def rerank(queries: DataFrame, references: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Exact search within each query's candidates (query, target) only; queries without any drop out."""
    pairs = candidates.select("query", "target").distinct().join(references, "target").join(queries.withColumnRenamed("features", "q"), "query")
    return top_k(pairs.select("query", "target", squared_l2(F.col("q"), F.col("features")).alias("d2")), k)


def expanded(queries: DataFrame, references: DataFrame, retrieval: DataFrame, k: int = 5, alpha: float = 0.8) -> DataFrame:
    """Average query expansion: alpha q + (1 - alpha) mean of the first k targets' vectors, position by position."""
    near = retrieval.where(F.col("rank") <= k).join(references, "target", "left")
    near = near.withColumn("features", F.coalesce("features", F.raise_error("a retrieved target has no vector")))
    mean = near.select("query", F.posexplode("features").alias("pos", "x")).groupBy("query", "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    mean = mean.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("mean"))
    mixed = F.zip_with("features", "mean", lambda q, m: alpha * q.cast("double") + (1 - alpha) * m)
    return queries.join(mean, "query").select("query", mixed.alias("features"))


def pooled(rows: DataFrame, key: str, vector: str, shape: tuple[int, int, int], attention: str | None = None, alpha: str | None = None, p: float = POWER, eps: float = EPS) -> DataFrame:
    """key, further columns but the arrays, and pooled: the generalised mean of each channel of flat channel-major maps.

    With ``attention`` (a map of height x width, NULL: plain) and ``alpha`` (up to 1e-6: plain) positions are weighted by
    existing + alpha (attention - existing); existing: a position's share of the power sums over channels against its
    mean. Batches of arrays are pooled in numpy. A map of another size than ``shape`` or with NULLs gives NULL.
    """
    channels, height, width = shape
    spots = height * width
    arrays = [vector, *([attention] if attention else [])]
    rest = [c for c in rows.columns if c not in arrays]
    schema = StructType([*(rows.schema[c] for c in rest), StructField("pooled", ArrayType(DoubleType()))])

    def fits(v: object, size: int) -> bool:
        return v is not None and len(v) == size and all(x is not None for x in v)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            good = np.array([fits(v, channels * spots) for v in b[vector]], bool)
            out: list[list[float] | None] = [None] * len(b)
            if good.any():
                at = np.flatnonzero(good)
                x = np.maximum(np.stack([np.asarray(b[vector].iloc[i], np.float64) for i in at]).reshape(-1, channels, spots), eps) ** p
                w = np.ones((len(at), spots))
                if attention:
                    existing = np.maximum(x.sum(1) / (spots + eps), eps) ** (1 / p)
                    existing /= existing.mean(1, keepdims=True) + eps
                    ratio = b[alpha].to_numpy(np.float64)[at]
                    given = [b[attention].iloc[i] for i in at]
                    on = (ratio > 1e-6) & np.array([fits(g, spots) for g in given], bool)
                    target = np.stack([np.asarray(g, np.float64) if o else np.ones(spots) for g, o in zip(given, on, strict=True)])
                    w = np.where(on[:, None], existing + ratio[:, None] * (target - existing), w)
                    total = w.sum(1) + np.where(on, eps, 0)
                else:
                    total = w.sum(1)
                for i, g in zip(at, (((w[:, None, :] * x).sum(2) / total[:, None]) ** (1 / p)).tolist(), strict=True):
                    out[i] = g
            yield b[rest].assign(pooled=out)

    return rows.mapInPandas(run, schema)


def projected(rows: DataFrame, key: str, vector: str, matrix: np.ndarray, bias: np.ndarray | None = None) -> DataFrame:
    """key, features: matrix x vector (+ bias), as a model's last layer. The matrix has the model's fixed size.

    A NULL vector or one of another length gives NULL.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[list[float] | None] = [None] * len(b)
            at = [i for i, v in enumerate(b[vector]) if v is not None and len(v) == matrix.shape[1]]
            if at:
                y = np.stack([np.asarray(b[vector].iloc[i], np.float64) for i in at]) @ matrix.T + (0 if bias is None else bias)
                for i, v in zip(at, y.tolist(), strict=True):
                    out[i] = v
            yield pd.DataFrame({key: b[key], "features": out})

    return rows.select(key, vector).mapInPandas(run, StructType([rows.schema[key], StructField("features", ArrayType(DoubleType()))]))


def unusable(rows: DataFrame, key: str, vector: str, size: int) -> DataFrame:
    """key, problem of the rows that a search leaves out: null, length or nan."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return rows.select(key, F.when(v.isNull(), "null").when(F.size(v) != size, "length").when(bad, "nan").alias("problem")).where("problem is not null")
