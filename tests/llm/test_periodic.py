"""Runs against a scan of all lags, on words with few letters, powers, broken powers and progressions of progressions."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from placegrid.llm import queries
from placegrid.llm.periodic import periodic_runs, runs_of
from placegrid.llm.word_blocks import word_hashes


def brute(words: list[bytes], least: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) by comparing the words of every lag."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                found.setdefault((i, j + q), q)  # lags ascend: the first is the least
            i = j
    return sorted((s, e - s, q) for (s, e), q in found.items())


def fast(docs: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    sizes = np.array([len(d) for d in docs], np.int64)
    rows = runs_of(sizes, np.array([h for d in docs for h in word_hashes(d)], np.uint64))
    return [[tuple(r) for r in rows[rows[:, 0] == i, 1:].tolist()] for i in range(len(docs))]


def some(seed: int) -> list[bytes]:
    """Powers of powers, with breaks, over few letters."""
    r = random.Random(seed)
    word: list[bytes] = [r.choice([b"a", b"b", b"c"][: r.randint(1, 3)]) for _ in range(r.randint(1, 9))]
    for _ in range(r.randint(1, 4)):
        word = word * r.randint(1, 5) + [r.choice([b"a", b"b", b"x"]) for _ in range(r.randint(0, 3))]
        if r.random() < 0.3:
            word = word + word[: r.randint(0, len(word))]
        word = word[:700]
    return word


def test_powers_of_powers() -> None:
    docs = [some(s) for s in range(400)]
    assert fast(docs) == [brute(d) for d in docs]


def test_progressions_side_by_side() -> None:
    docs = []
    for p in (1, 2, 3, 5, 8, 12, 17):
        for m in (20, 40, 61):
            unit = [b"%d" % i for i in range(p)]
            for tail in (0, 1, p // 2, p - 1):
                half = unit * m + unit[:tail]
                docs += [(half + half)[:900], (half + [b"z"] + half)[:900], (half + half[1:] + half)[:900]]
    assert fast(docs) == [brute(d) for d in docs]


def test_fibonacci_and_thue_morse() -> None:
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 800:
        a, b = b, b + a
    morse = [b"%d" % (bin(i).count("1") & 1) for i in range(1024)]
    docs = [b, morse, b[:500] + morse[:300], [b"x"] * 700]
    assert fast(docs) == [brute(d) for d in docs]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b"]), max_size=160), max_size=5))
def test_two_letters(docs: list[list[bytes]]) -> None:
    assert fast(docs) == [brute(d) for d in docs]


SCHEMA = "text string, doc_id long, length int, runs string, n_words int"


def test_edges_and_clashing_columns(spark) -> None:
    rows = [(None, 1, 1, "r", 2), ("", 2, 1, "r", 2), (" \t\n ", 3, 1, "r", 2), ("a " * 12, 4, 1, "r", 2), ("a " * 12, 4, 1, "r", 2), ("a b " * 20, None, None, None, None)]
    got = periodic_runs(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], bytes(r.collapsed)) for r in got) == [
        (0, 40, [(0, 40, 2)], b"a b"), (1, 0, [], b""), (2, 0, [], b""), (3, 0, [], b""), (4, 12, [(0, 12, 1)], b"a"), (4, 12, [(0, 12, 1)], b"a"),
    ]
    assert periodic_runs(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [1])
def test_query_against_brute_force(spark, tmp_path, n: int) -> None:
    texts = [None, "", "a", "w " * 30, *(" ".join(x.decode() for x in some(s)) for s in range(40)), *(" ".join(f"w{(i * 7 + s) % (50 + s)}" for i in range(300)) for s in range(60))]
    spark.createDataFrame([(i, t, "en", "web", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_periodic_minimizers(spark, str(tmp_path)).collect()}
    assert len(got) == len(texts)
    planted = 0
    for i, t in enumerate(texts):
        words = (t or "").encode().split()
        h, n = zlib.crc32(str(i).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
            planted += 1
        runs = brute(words)
        gone = {j for s, size, q in runs for j in range(s + q, s + size)}
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        r = got[i]
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period, r.exponent_milli) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(w for j, w in enumerate(words) if j not in gone)).hexdigest()
    assert planted
