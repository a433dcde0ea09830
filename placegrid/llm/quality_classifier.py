"""Supervised subword embeddings for quality: hashed word and character n-gram vectors, averaged, then a softmax.

Training is numpy stochastic gradient descent on the driver over a bounded sample of labelled documents (``ROWS`` rows
and ``SIZE`` bytes of whole texts, in an order by hash). As the score is linear in the average, a bucket's vector
folds into one number at scoring, and so does a word, so each executor only needs a table of ``BUCKETS`` floats.

Nulls and edges: a null or blank text scores the bias alone; a null doc_id is scored, never learned from; repeated
rows score alike; without labels of both classes every score is the prior; further columns are ignored, and pass through
``kept_documents``, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegrid.llm.common import extended, mapped, texts, tune
from placegrid.llm.hashed import CACHE, sample, subwords

BUCKETS, DIM = 1 << 17, 6
ROWS, SIZE = 3000, 24 << 20
#: Steps of the gradient descent at least, so that few labels train as far as many.
STEPS = 1000


def held_out() -> Column:
    """True if the CRC-32 of the id as text is divisible by 5 (null id: null)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


#: Words of the delexicalised bigrams: a word that equals the one before it, and one that does not.
SAME, OTHER = b"\x00same", b"\x00other"


def counted(text: bytes) -> Counter:
    """The words of a text and its bigrams' kinds, with their counts."""
    words = text.split()
    found = Counter(words)
    if len(words) > 1:
        same = sum(map(eq, words, words[1:]))
        found[SAME] += same
        found[OTHER] += len(words) - 1 - same
    return found


def train(data: pd.DataFrame, epochs: int = 5, rate: float = 2.0, batch: int = 16, seed: int = 1) -> tuple[np.ndarray, float]:
    """Folded scores of the buckets (the difference of the two classes' logits) and the bias."""
    rng = np.random.default_rng(seed)
    vectors = np.zeros((BUCKETS, DIM), np.float32)  # what is never seen adds nothing; the output starts at random
    out, bias = rng.normal(0, 1, (2, DIM)).astype(np.float32), np.zeros(2, np.float32)
    y, docs = data["label"].to_numpy(), []
    for text in data["text"]:
        words = counted(text)
        ids, of = subwords(list(words), BUCKETS)
        weight = np.fromiter(words.values(), np.float32, len(words))[of]
        docs.append((ids, weight / max(weight.sum(), 1)))
    prior = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
    if len(set(y.tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior)))
    bias[:] = 0, np.log(prior / (1 - prior))
    each = -(-len(docs) // batch)
    epochs = max(epochs, -(-STEPS // each))
    steps, done = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(order), batch):
            some = order[at : at + batch]
            ids = np.concatenate([docs[i][0] for i in some])
            weight = np.concatenate([docs[i][1] for i in some])
            of = np.repeat(np.arange(len(some)), [len(docs[i][0]) for i in some])
            part = vectors[ids] * weight[:, None]
            mean = np.stack([np.bincount(of, part[:, j], len(some)) for j in range(DIM)], 1).astype(np.float32)
            logit = mean @ out.T + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            step = rate * (1 - done / steps)
            back = p @ out  # before the output moves
            out -= step / len(some) * 4 * (p.T @ mean)
            bias -= step / len(some) * 0.1 * p.sum(0)
            move = -step * back[of] * weight[:, None]
            for j in range(DIM):
                vectors[:, j] += np.bincount(ids, move[:, j], BUCKETS)
            done += 1
    return (vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0])


def scorer(folded: np.ndarray, bias: float) -> Callable[[list], dict]:
    """Scores of whole texts under a trained table, which has a fixed size and so travels with the task."""
    known: dict[bytes, tuple[float, int]] = {}

    def run(texts: list) -> dict:
        found = [counted(t or b"") for t in texts]
        if len(known) >= CACHE:
            known.clear()
        if new := list({w for words in found for w in words if w not in known}):
            ids, of = subwords(new, BUCKETS)
            sums, sizes = np.bincount(of, folded[ids], len(new)), np.bincount(of, minlength=len(new))
            known.update(zip(new, zip(sums.tolist(), sizes.tolist(), strict=True), strict=True))
        z = []
        for words in found:
            total = count = 0.0
            for w, n in words.items():
                s, size = known[w]
                total += n * s
                count += n * size
            z.append(bias + (total / count if count else 0.0))
        return {"score": 1 / (1 + np.exp(-np.clip(np.array(z), -50, 50)))}

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """doc_id, score (probability of quality 1); learned only from labels that are not held out."""
    tune(docs.sparkSession)
    data = sample(docs, labels.where(~held_out()), "quality", rows, size)
    data["label"] = data["label"].clip(0, 1)
    run = scorer(*train(data))
    return mapped(texts(docs), lambda c: {"doc_id": c["doc_id"]} | run(c["text"]), "doc_id long, score double")


def kept_documents(docs: DataFrame, labels: DataFrame, least: float = 0.3, rows: int = ROWS, size: int = SIZE) -> DataFrame:
    """The documents whose score is at least ``least``, with their own columns."""
    tune(docs.sparkSession)
    data = sample(docs, labels.where(~held_out()), "quality", rows, size)
    data["label"] = data["label"].clip(0, 1)
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called, none clashes
    rows_ = extended(docs.toDF(*names), scorer(*train(data)), "score double", names[docs.columns.index("text")])
    return rows_.where(F.col("score") >= least).select(*names).toDF(*docs.columns)
