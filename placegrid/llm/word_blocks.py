"""Repeated word sequences through fixed-block anchors.

A word is removed if a window of ``WINDOW`` consecutive words of its document covers it whose sequence also starts
anywhere else. Every such window holds a whole block of ``BLOCK`` = (WINDOW + 1) / 2 words that starts at a multiple of
BLOCK in its document. These non-overlapping blocks are the index; every rolling window of BLOCK words of the corpus
probes it (first exchange). Around the blocks that are hit elsewhere, hits are extended: the windows of WINDOW words over
a hit block are compared as whole sequences (second exchange, 128-bit hashes), and the union of the equal ones is the
maximal exact repeats. Nothing is paired, so a passage in k documents costs k keys, not k squared links.

Nulls and edges: a null text has no words; a text shorter than a window keeps all; repeated rows remove each other; a
null doc_id is treated like any other; extra columns are ignored; an empty table gives no rows. A task holds a document
whole. A false repeat needs two of n windows over hit blocks to share 128 bits of hashes: n squared over 2^129.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from xxhash import xxh64_intdigest

from placegrid.llm.common import mix, partitions
from placegrid.llm.exchange import Chunk, Keys, chunked, covered, distinct, exchanged, finished, from_reply, prefix_sums, wide_hashes, window_hashes

WINDOW = 35
#: Bits of a probe's hash; probes only choose what is compared in full.
PROBE_BITS = 48
CACHE = 200_000
_known: dict[bytes, int] = {}


def word_hashes(words: list[bytes]) -> list[int]:
    if len(_known) > CACHE:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = xxh64_intdigest(w, 5)
    return list(map(_known.__getitem__, words))


class Windows:
    """Rolling windows of a chunk: word counts, and for a window size its starts and hashes."""

    def __init__(self, chunk: Chunk) -> None:
        self.words = [t.split() for t in chunk.texts]
        self.counts = np.array([len(w) for w in self.words], np.int64)
        x = np.fromiter((h for w in self.words for h in word_hashes(w)), np.uint64, int(self.counts.sum()))
        self.first = np.cumsum(self.counts) - self.counts
        self.end = np.repeat(self.first + self.counts, self.counts)  # of the document of each word
        self.place = np.arange(len(x)) - np.repeat(self.first, self.counts)  # within it
        self.values = mix(x)
        self.sums, self.down = prefix_sums(self.values)

    def starts(self, size: int) -> np.ndarray:
        at = np.arange(len(self.end))
        return at[at + size <= self.end]

    def hashes(self, start: np.ndarray, size: int) -> np.ndarray:
        return window_hashes(self.sums, self.down, start, size)


def probes(w: Windows, block: int) -> tuple[Keys, np.ndarray, np.ndarray]:
    """Keys (all rolling windows, blocks asked for), the starts of the blocks, and their keys' places."""
    start = w.starts(block)
    keys, at = distinct(w.hashes(start, block) >> np.uint64(64 - PROBE_BITS) << np.uint64(64 - PROBE_BITS))
    aligned = w.place[start] % block == 0
    asked = np.zeros(len(keys.key), bool)
    asked[at[aligned]] = True
    return keys._replace(asked=asked), start[aligned], at[aligned]


def candidates(w: Windows, window: int, block: int, reply: bytes) -> np.ndarray:
    """Starts of the windows whose first whole block is hit elsewhere."""
    keys, start, at = probes(w, block)
    hit = np.zeros(len(keys.key), bool)
    hit[keys.asked] = from_reply(reply, int(keys.asked.sum()), 1)
    hot = np.zeros(len(w.end) + 1, bool)
    hot[start[hit[at]]] = True
    s = w.starts(window)
    return s[hot[s + (-w.place[s]) % block]]


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the kept words joined by a space, UTF-8 bytes) and its kept_sha256."""
    block = (window + 1) // 2
    ranges = partitions(docs, 6 << 20)
    chunks = chunked(docs)
    probed = exchanged(chunks, "probe", lambda c, _: probes(Windows(c), block)[0], ranges=ranges)

    def extended(c: Chunk, reply: bytes) -> tuple[Windows, np.ndarray, Keys, np.ndarray]:
        w = Windows(c)
        start = candidates(w, window, block, reply)
        return w, start, *distinct(*wide_hashes(w.values, w.sums, w.down, start, window))

    compared = exchanged(probed, "same", lambda c, got: extended(c, got["probe"])[2], ranges=ranges)

    def finish(c: Chunk, got: dict[str, bytes]) -> dict:
        w, start, keys, at = extended(c, got["probe"])
        again = from_reply(got["same"], len(keys.key), 1).astype(bool)[at]
        flags = np.zeros(len(w.end), bool)
        flags[start[again]] = True
        gone = covered(flags, window)
        kept = []
        for words, lo in zip(w.words, w.first.tolist(), strict=True):
            mask = gone[lo : lo + len(words)]
            kept.append(b" ".join(words) if not mask.any() else b" ".join([x for x, g in zip(words, mask.tolist(), strict=True) if not g]))
        removed = np.add.reduceat(np.r_[gone, False].astype(np.int64), np.minimum(w.first, len(gone))) * (w.counts > 0) if len(w.counts) else []
        return {"doc_id": c.ids, "n_words": w.counts, "n_removed": removed, "kept": kept, "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept]}

    return finished(compared, finish, "doc_id long, n_words long, n_removed long, kept binary, kept_sha256 string")
