"""Plans over few distinct lengths, many pieces, and texts that are empty."""

from __future__ import annotations

import time

import numpy as np
import public_tokenizers
import pytest

from placegrid.llm import packing


@pytest.mark.parametrize("pieces", [{1: 10_000}, {1: 3000, 5: 1}, {1: 2499, 37: 1}, {1: 10**9, 700: 10**6}, {n: 1 for n in range(1, 2049)}, {n: 50 + n for n in range(1, 41)}, {1: 100_000, 2: 5, 3: 7000, 2000: 40, 2047: 3}])
def test_plans_reach_the_lower_bound_in_time(pieces: dict[int, int]) -> None:
    counts = np.zeros(2049, np.int64)
    counts[list(pieces)] = list(pieces.values())
    began = time.time()
    plan = packing.planned_runs(counts, 2048)
    packing.slots(plan)
    assert time.time() - began < 2
    used, sequences = np.zeros(2049, np.int64), 0
    for runs, copies in plan:
        assert copies > 0 and sum(p * n for p, n in runs) <= 2048
        for p, n in runs:
            used[p] += n * copies
        sequences += copies
    assert (used == counts).all()
    assert sequences <= -(-(counts * np.arange(2049)).sum() // 2048) + 1


@pytest.mark.parametrize("texts", [[None] * 10_000, [""] * 3000 + ["some words of a text that is not empty"]])
def test_many_empty_texts(spark, texts: list[str | None]) -> None:
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    out = packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json")).toPandas()
    assert sorted(out["doc_id"]) == list(range(len(texts)))
    assert out["sequence_id"].nunique() == -(-out["length"].sum() // 2048)
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]] and g["length"].sum() <= 2048
