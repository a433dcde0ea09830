"""Model inference by batches through ``predict_batch_udf``, with an error in its own row and halving for want of memory.

Inputs travel as bytes (little-endian 32-bit numbers, or what the model's ``load`` reads), so one column carries images and
arrays of any shape. The model is loaded once a Python worker and gives vectors of one length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from placegrid.sources.plugins import Model, outcomes

RESULT = StructType([StructField("features", ArrayType(FloatType())), StructField("error", StringType())])

def packed(vector: Column) -> Column:
    """An array of numbers as bytes."""

    @F.pandas_udf("binary")
    def run(v):
        return v.map(lambda x: None if x is None else np.asarray(x, "<f4").tobytes())

    return run(vector)


def prediction(content: Column, load: Callable[[], Model], batch: int = 32) -> Column:
    """struct(features, error) of each row's content; where there is an error or no content the features say nothing."""

    def make() -> Callable[[np.ndarray], dict[str, np.ndarray]]:
        model = load()

        def predict(contents: np.ndarray) -> dict[str, np.ndarray]:
            there = [i for i, c in enumerate(contents) if c is not None]
            found = outcomes(model, [bytes(contents[i]) for i in there])
            width = max((len(f) for f, _ in found if f is not None), default=1)
            features, errors = np.full((len(contents), width), np.nan, np.float32), np.full(len(contents), None, object)
            for i, (f, e) in zip(there, found, strict=True):
                errors[i] = e
                if f is not None:
                    features[i] = f
            return {"features": features, "error": errors}

        return predict

    return predict_batch_udf(make, return_type=RESULT, batch_size=batch)(content)


def predicted(images: DataFrame, load: Callable[[], Model], batch: int = 32) -> DataFrame:
    """path, features, error for rows (path, content): the rows of ``plugins.inferred``. A NULL content has neither."""
    rows = images.select("path", "content", prediction(F.col("content"), load, batch).alias("p"))
    return rows.select("path", F.when(F.col("content").isNotNull() & F.col("p.error").isNull(), F.col("p.features")).alias("features"), F.col("p.error").alias("error"))
