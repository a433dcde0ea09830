"""The merge's decisions against brute force on dense anchors, without Spark."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from placegrid.llm import byte_suffixes, exchange


def flagged(chunks, length):
    """Starts of repeated strings of each chunk, by the operator's own steps."""
    parses = [byte_suffixes.Parse(c) for c in chunks]
    states = byte_suffixes.merged([p.keys for p in parses])
    found = [byte_suffixes.Strings(c, exchange.to_reply(s, 8), length) for c, s in zip(chunks, states, strict=True)]
    same = exchange.repeated([f.keys for f in found])
    return [sorted([*f.known.tolist(), *f.at[x[f.place] > 0].tolist()]) for f, x in zip(found, same, strict=True)], sum(len(f.known) for f in found)


@pytest.mark.parametrize("seed", range(12))
def test_intervals_and_strings(monkeypatch, seed):
    monkeypatch.setattr(byte_suffixes, "GRAM", 3)
    monkeypatch.setattr(byte_suffixes, "SPARSE", 2 + seed % 4)
    monkeypatch.setattr(byte_suffixes, "BLOCK", 150)
    rng, length = np.random.default_rng(seed), 16
    alphabet = list(b"ab" if seed % 3 == 0 else b"abcdefgh")
    text = lambda n: bytes(rng.choice(alphabet, n).tolist())
    passages = [text(int(rng.integers(10, 60))) for _ in range(4)]
    chunks, whole = [], [text(90) for _ in range(3)]
    for _ in range(4):
        texts = [b"", text(5), whole[int(rng.integers(0, 3))], b"a" * int(rng.integers(0, 40))]
        for _ in range(5):
            texts.append(text(int(rng.integers(0, 40))) + passages[int(rng.integers(0, 4))][int(rng.integers(0, 6)) :] + text(int(rng.integers(0, 40))))
        chunks.append(exchange.Chunk(list(range(len(texts))), texts, []))
    count = Counter(t[i : i + length] for c in chunks for t in c.texts for i in range(len(t) - length + 1))
    want = []
    for c in chunks:
        base, own = 0, []
        for t in c.texts:
            own += [base + i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1]
            base += len(t)
        want.append(own)
    got, decided = flagged(chunks, length)
    assert got == want and (decided > 0 or seed % 3 == 0)
