"""Where models are plugged in: image models and vision-language models run in Python workers, row by row.

A plug-in is a function from a batch of inputs to as many outputs. It is loaded once a worker; an input that fails gives
an error in its own row and never spoils its batch: after a failed batch the inputs are tried one by one.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from placegrid.sources.agents import worker

Model = Callable[[list[bytes]], list[list[float]]]


def outcomes(model: Model, contents: list[bytes]) -> list[tuple[list[float] | None, str | None]]:
    """(features, error) of each content. A batch that fails for want of memory is halved; other errors are laid to single contents."""

    def one(content: bytes) -> tuple[list[float] | None, str | None]:
        try:
            return model([content])[0], None
        except Exception as e:  # noqa: BLE001
            return None, repr(e)

    if not contents:
        return []
    try:
        return [(f, None) for f in model(contents)]
    except Exception as e:  # noqa: BLE001
        if len(contents) > 1 and (isinstance(e, MemoryError) or "out of memory" in str(e).lower()):
            half = len(contents) // 2
            return outcomes(model, contents[:half]) + outcomes(model, contents[half:])
        return [one(c) for c in contents]


def inferred(images: DataFrame, load: Callable[[], Model], batch: int = 32, name: str | None = None) -> DataFrame:
    """path, features, error for rows (path, content). ``name`` tells models apart; each is loaded once a worker.

    A batch that fails for want of memory is halved until it fits; other errors are laid to single inputs.
    """
    name = name or f"model-{uuid.uuid4().hex}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = worker(name, load)
        for b in batches:
            rows = []
            for at in range(0, len(b), batch):
                part = b.iloc[at : at + batch]
                rows += [(p, *g) for p, g in zip(part["path"], outcomes(model, list(part["content"])), strict=True)]
            yield pd.DataFrame(rows, columns=["path", "features", "error"])

    return images.select("path", "content").mapInPandas(run, "path string, features array<float>, error string")


def stub_model(size: int = 16) -> Model:
    """A deterministic stand-in for tests: features from the content's hash."""
    return lambda contents: [[b / 255 for b in hashlib.sha256(c).digest()[:size]] for c in contents]
