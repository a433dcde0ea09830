"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade <= k | x) = sigmoid(theta_k - w.x): one weight vector is shared by all ordered thresholds. x marks which hashed
words and word starts a text has. The result is the expected severity, sum over k of P(grade > k), besides P(grade > 0).

Trained in numpy on the driver (AdaGrad steps with an L1 penalty) over a bounded sample of labelled documents (``ROWS``,
``SIZE``); scoring needs a table of ``BUCKETS`` floats.

The labels table marks toxicity as 0 or 1 only. ``graded`` splits the marked documents into GRADES - 1 severities by
the share of words whose stem occurs in many marked and in no unmarked training document.

Nulls and edges: a null or blank text has no features and gets the thresholds' own severity; null labels and ids are
not learned from; repeated rows score alike; with one grade only, all score zero; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from placegrid.llm.common import mapped, texts, tune
from placegrid.llm.hashed import CACHE, sample, stems

BUCKETS, GRADES = 1 << 18, 3
ROWS, SIZE = 9000, 40 << 20
#: Training documents that a feature must occur in.
COMMON = 4


def features(text: bytes) -> np.ndarray:
    found = {f for w in set(text.split()) for f in stems(w, BUCKETS)}
    return np.fromiter(sorted(found), np.int32, len(found))


def graded(data: pd.DataFrame, rows: list[np.ndarray], grades: int = GRADES) -> np.ndarray:
    """Severities 0 .. grades - 1 from marks 0 or 1."""
    marked = data["label"].to_numpy() > 0
    count = lambda on: np.bincount(np.concatenate([np.zeros(0, np.int32), *(r for r, m in zip(rows, marked, strict=True) if m == on)]), minlength=BUCKETS)
    telling = (count(True) >= 5) & (count(False) == 0)
    share = np.array([telling[[f for w in t.split() for f in stems(w, BUCKETS)[:1]]].mean() if t.split() and m else 0.0 for t, m in zip(data["text"], marked, strict=True)])
    out = np.zeros(len(data), np.int64)
    if marked.any():
        cuts = np.quantile(share[marked], np.arange(1, grades - 1) / (grades - 1))
        out[marked] = 1 + np.searchsorted(cuts, share[marked], side="left")
    return np.minimum(out, grades - 1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(rows: list[np.ndarray], grade: np.ndarray, grades: int = GRADES, epochs: int = 4, rate: float = 0.3, sparse: float = 2.0, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds, by follow-the-regularised-leader (AdaGrad steps, L1) on the cumulative links."""
    rng = np.random.default_rng(seed)
    often = np.bincount(np.concatenate([np.zeros(0, np.int32), *rows]), minlength=BUCKETS) >= COMMON
    rows = [r[often[r]] for r in rows]
    z, seen, w = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    below = np.array([(grade <= k).mean() if len(grade) else 1.0 for k in range(grades - 1)])
    theta = np.log((below + 1e-3) / (1 - below + 1e-3)) + np.arange(grades - 1) * 1e-3
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, y = rows[i], grade[i]
            c = sigmoid(theta - w[f].sum())
            low, high = (c[y - 1] if y else 0.0), (c[y] if y < grades - 1 else 1.0)
            p = max(high - low, 1e-9)
            dlow, dhigh = low * (1 - low), high * (1 - high)
            g = (dhigh - dlow) / p  # slope of the negative log-likelihood in w.x
            old = seen[f]
            seen[f] = old + g * g
            z[f] += g - (np.sqrt(seen[f]) - np.sqrt(old)) / rate * w[f]
            w[f] = np.where(np.abs(z[f]) <= sparse, 0, -(z[f] - np.sign(z[f]) * sparse) / ((1 + np.sqrt(seen[f])) / rate))
            if y < grades - 1:
                theta[y] += 0.02 * dhigh / p
            if y:
                theta[y - 1] -= 0.02 * dlow / p
            theta = np.maximum.accumulate(theta)
    return w.astype(np.float32), theta


def scored(docs: DataFrame, w: np.ndarray, theta: np.ndarray) -> DataFrame:
    known: dict[bytes, tuple[int, ...]] = {}

    def active(word: bytes) -> tuple[int, ...]:
        if (got := known.get(word)) is None:
            if len(known) >= CACHE:
                known.clear()
            got = known[word] = tuple(f for f in stems(word, BUCKETS) if w[f])
        return got

    def run(c: dict) -> dict:
        x = np.array([sum(float(w[f]) for f in {f for word in set((t or b"").split()) for f in active(word)}) for t in c["text"]])
        above = 1 - sigmoid(theta[None, :] - x[:, None])
        grade = (above > 0.5).sum(axis=1)
        return {"doc_id": c["doc_id"], "expected_severity": above.sum(axis=1), "p_toxic": above[:, 0], "grade": grade.astype(np.int32)}

    return mapped(texts(docs), run, "doc_id long, expected_severity double, p_toxic double, grade int")


def toxicity(docs: DataFrame, labels: DataFrame, rows: int = ROWS, size: int = SIZE, grades: int = GRADES) -> DataFrame:
    """doc_id, expected_severity (0 .. grades - 1), p_toxic, grade of every whole text."""
    tune(docs.sparkSession)
    data = sample(docs, labels, "toxic", rows, size)
    found = [features(t) for t in data["text"]]
    return scored(docs, *train(found, graded(data, found, grades), grades))
