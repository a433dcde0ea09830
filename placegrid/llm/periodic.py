"""Runs (maximal periodic stretches of words) through multi-scale minimizers.

A run is a stretch of consecutive words of one document with smallest period q (words q apart are identical) and length
``max(LEAST, 2 q)`` or more that no neighbouring word extends keeping period q. They are found in each document exactly:

* Periods below ``SHORT`` are scanned directly: words are compared with those q places on, lag by lag.
* For every scale w (a power of two from SHORT / 2 on), which serves the periods q in [2 w, 4 w), the w-word grams get
  hashes, and the leftmost least gram of every window of w grams is a minimizer. Inside a run of such a period the windows
  at its start and q later are equal, so both choose the same place: equal minimizers at distance q seed the run.
* A seed is extended both ways to the maximal stretch by comparing hashes of power-of-two blocks, longest first.

Grams with a short period of their own make minimizers in arithmetic progressions. Two progressions of equal grams need
one pair for each distance, and one with an end of either has every distance; so only pairs with an end are tried, and
their number stays in proportion to the words. A stretch found with several periods has the least of them: the others
are its multiples (Fine and Wilf).

Nulls and edges: a null or empty text, and one of white space, has no words and no runs; repeated rows are each treated
alike; a null doc_id is like any other; extra columns are ignored; an empty table gives no rows. A task holds a document
whole. Blocks are compared by 64-bit hashes of a tree of mixes, which has no known structured collisions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from placegrid.llm.common import mapped, mix, texts, tune
from placegrid.llm.word_blocks import word_hashes

#: A run has this many words at least.
LEAST = 12
#: Periods below it are scanned lag by lag.
SHORT = 16
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches of true values."""
    at = np.flatnonzero(same)
    if not len(at):
        return at, at
    new = np.flatnonzero(np.diff(at) > 1)
    return at[np.r_[0, new + 1]], at[np.r_[new, len(at) - 1]] + 1


class Blocks:
    """Hashes of all blocks of 2^j values; level j reaches only as far as documents of 2^j words or more."""

    def __init__(self, values: np.ndarray, reach: list[int]) -> None:
        self.levels = [values]
        for j, n in enumerate(reach):
            low = self.levels[-1][:n]
            if len(low) <= 1 << j:
                break
            self.levels.append(mix(low[: -(1 << j)] * MULTIPLIER + low[1 << j :]))

    def ahead(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch from x on and from y (> x) on."""
        done = np.zeros(len(x), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            level, a, b = self.levels[j], x + done, y + done
            inside = b < len(level)
            equal = inside & (level[np.where(inside, a, 0)] == level[np.where(inside, b, 0)])
            done += equal.astype(np.int64) << j
        return done

    def behind(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the longest common stretch that ends before x and before y (> x)."""
        done = np.zeros(len(x), np.int64)
        for j in range(len(self.levels) - 1, -1, -1):
            level, a, b = self.levels[j], x - done - (1 << j), y - done - (1 << j)
            inside = (a >= 0) & (b < len(level))
            equal = inside & (level[np.where(inside, a, 0)] == level[np.where(inside, b, 0)])
            done += equal.astype(np.int64) << j
        return done


def minimizers(grams: np.ndarray, w: int) -> np.ndarray:
    """Places of the leftmost least of each window of ``w`` grams."""
    if len(grams) < w:
        return np.zeros(0, np.int64)
    bits = np.uint64(max(20, len(grams).bit_length()))
    least = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    step = 1
    while step < w:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return at[np.r_[True, at[1:] != at[:-1]]]


def between(places: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i all indices of the sorted ``places`` with a value in [low, high): (i repeated, indices)."""
    first, last = np.searchsorted(places, low), np.searchsorted(places, high)
    n = np.maximum(last - first, 0)
    of = np.repeat(np.arange(len(low)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[of]


def seeds(grams: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (x, y) of equal minimizers with y - x in [2 w, 4 w): for each run of such a period at least one."""
    at = minimizers(grams, w)
    value = grams[at]
    order = np.argsort(value, kind="stable")
    value, at = value[order], at[order]
    same, gap = value[1:] == value[:-1], np.diff(at)
    near = same & (gap < 4 * w)
    held = np.r_[near, False] | np.r_[False, near]  # a partner within reach
    if not held.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    value, at = value[held], at[held]
    same, gap = value[1:] == value[:-1], np.diff(at)
    step = np.where(same & (gap <= w // 2), gap, 0)  # 0: no progression here
    end = ~((np.r_[0, step] == np.r_[step, 0]) & (np.r_[0, step] > 0))
    place = np.cumsum(np.r_[0, ~same]) * (len(grams) + 4 * w) + at  # groups lie further apart than pairs
    ends = np.flatnonzero(end)
    left, right = between(place, place[ends] + 2 * w, place[ends] + 4 * w)
    other, own = between(place, place[ends] - 4 * w + 1, place[ends] - 2 * w + 1)
    return np.r_[at[ends[left]], at[own]], np.r_[at[right], at[ends[other]]]


def runs_of(sizes: np.ndarray, values: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (document, start, length, period) of all runs, by document, start and period.

    ``values``: 64-bit hashes of the words of all documents one after another, ``sizes`` words each.
    """
    order = np.argsort(-sizes, kind="stable")  # long documents first: each scale looks at a prefix
    first, long = np.cumsum(sizes) - sizes, sizes[order]
    start = np.cumsum(long + 1) - long  # one separator, unlike anything else, before each document and at the end
    x = mix(~np.arange(int(start[-1] + long[-1] + 1) if len(long) else 1, dtype=np.uint64))
    of = np.repeat(np.arange(len(long)), long)
    within = np.arange(len(of)) - np.repeat(np.cumsum(long) - long, long)
    x[start[of] + within] = mix(values[first[order][of] + within])
    most = int(long[0]) if len(long) else 0

    def reach(n: int) -> int:
        """Values of the documents of ``n`` words or more."""
        k = int(np.searchsorted(-long, -n, side="right"))
        return int(start[k - 1] + long[k - 1] + 1) if k else 0

    found = []
    for q in range(1, min(SHORT, most // 2 + 1)):
        y = x[: reach(max(least, 2 * q))]
        lo, hi = stretches(y[:-q] == y[q:])
        good = hi - lo + q >= max(least, 2 * q)
        found.append(np.stack([lo[good], hi[good] + q, np.full(int(good.sum()), q)], 1))
    w = SHORT // 2
    if most >= 4 * w:
        blocks = Blocks(x, [reach(2 << j) for j in range(most.bit_length() - 1)])
        while most >= 4 * w:
            left, right = seeds(blocks.levels[w.bit_length() - 1][: reach(4 * w)], w)
            if len(left):
                lo, hi = left - blocks.behind(left, right), right + blocks.ahead(left, right)
                q = right - left
                good = hi - lo >= np.maximum(least, 2 * q)
                found.append(np.stack([lo[good], hi[good], q[good]], 1))
            w *= 2
    rows = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    rows = rows[np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)]] if len(rows) else rows  # the least period of a stretch
    doc = np.searchsorted(start, rows[:, 0], side="right") - 1
    out = np.stack([order[doc], rows[:, 0] - start[doc], rows[:, 1] - rows[:, 0], rows[:, 2]], 1)
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period) and collapsed (UTF-8 bytes) of every document.

    ``collapsed``: the words joined by a space, without those that any run contains after its first period.
    """
    tune(docs.sparkSession)

    def run(c: dict) -> dict:
        words = [(t or b"").split() for t in c["text"]]
        sizes = np.array([len(w) for w in words], np.int64)
        rows = runs_of(sizes, np.fromiter((h for w in words for h in word_hashes(w)), np.uint64, int(sizes.sum())), least)
        stop = np.searchsorted(rows[:, 0], np.arange(len(words)), side="right").tolist()
        runs, kept, lo = [], [], 0
        for w, hi in zip(words, stop, strict=True):
            runs.append([{"start": s, "length": n, "period": q} for s, n, q in rows[lo:hi, 1:].tolist()])
            if hi > lo:
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, rows[lo:hi, 1] + rows[lo:hi, 3], 1)
                np.add.at(edge, rows[lo:hi, 1] + rows[lo:hi, 2], -1)
                w = [x for x, n in zip(w, np.cumsum(edge).tolist(), strict=False) if not n]
            kept.append(b" ".join(w))
            lo = hi
        return {"doc_id": c["doc_id"], "n_words": sizes, "runs": runs, "collapsed": kept}

    return mapped(texts(docs), run, f"doc_id long, n_words long, runs {RUNS}, collapsed binary")
