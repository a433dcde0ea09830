"""Near words, forms and roots against a comparison of all words with all; counts against a plain count."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from placegrid.llm import queries
from placegrid.llm.spelling import counted, paths, spelling_variants


def is_near(a: str, b: str) -> bool:
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words: dict[str, int]) -> dict[str, tuple]:
    out = {}
    for w, n in words.items():
        close = [v for v in words if is_near(w, v)]
        best = min(close, key=lambda v: (-words[v], v), default=None)
        out[w] = (best if best and words[best] >= 10 * n else None, n, len(close))
    rows = {}
    for w, (form, n, near) in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        rows[w] = (form, root, n, near, words[form] if form else None)
    return rows


def got(rows) -> dict[str, tuple]:
    found = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows.collect()]
    assert len({r[0] for r in found}) == len(found)
    return {r[0]: r[1:] for r in found}


def test_paths_number_trie_nodes() -> None:
    keys = sorted({"".join(random.Random(s).choices("ab", k=s % 6)) for s in range(60)} - {""})
    nodes = {}
    for key, path in zip(keys, paths(keys), strict=True):
        for d, x in enumerate(path):
            assert nodes.setdefault(x, key[:d]) == key[:d]
    assert sorted(nodes) == list(range(len({k[:d] for k in keys for d in range(len(k) + 1)})))


@pytest.mark.parametrize(("alphabet", "size", "seed"), [("ab", (1, 7), 1), ("abc", (3, 6), 2), ("aéÿz", (2, 5), 3), ("abcdefgh", (7, 9), 4)])
def test_all_pairs(spark, alphabet: str, size: tuple[int, int], seed: int) -> None:
    r = random.Random(seed)
    words = {"".join(r.choices(alphabet, k=r.randint(*size))) for _ in range(260)}
    words |= {w[:i] + w[i + 1 :] for w in list(words)[:60] for i in (0, 2) if len(w) > 3} | {"a" * k for k in range(1, 12)}
    table = {w: int(10 ** r.uniform(0, 7)) + 2 for w in words}
    rows = spark.createDataFrame(list(table.items()), "word string, n long").repartition(5)
    assert got(spelling_variants(rows)) == brute(table)


def test_ranges_and_hot_prefix(spark) -> None:
    """One prefix holds most words and spans all ranges; chains of forms; ties by code-point order."""
    words = {f"communi{a}{b}{c}": 3 for a in "abcdefgh" for b in "abcdefgh" for c in "abcd"}
    words |= {"communicate": 10**9, "comunicate": 10**7, "comunicat": 10**5, "omunicat": 1000, "omunicatt": 50, "alphabeta": 500, "alphabetb": 500, "alphabetz": 50}
    rows = spark.createDataFrame(list(words.items()), "word string, n long").repartition(7)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert got(spelling_variants(rows)) == brute(words)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


SCHEMA = "word string, text string, doc_id long, n int"


def test_counts_and_edges(spark) -> None:
    rows = [(None, None, 1, 1), ("w", "", 2, 1), ("w", "Straße straÃe élégante Élégante ELEGANTE×elegante1elegante abcdef", 3, None), ("w", "elegante " * 3, None, 2), ("w", "elegante " * 3, None, 2)]
    assert {r.word: r.n for r in counted(spark.createDataFrame(rows, SCHEMA)).collect()} == {"elegante": 7}
    assert {r.word: r.n for r in counted(spark.createDataFrame(rows, SCHEMA), occurrences=1).collect()} == {"elegante": 7, "élégante": 1, "Élégante": 1, "elegante×elegante": 1}
    empty = spelling_variants(counted(spark.createDataFrame([], SCHEMA)))
    assert empty.collect() == []


def test_query_against_brute_force(spark, tmp_path) -> None:
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcé", k=r.randint(7, 9))) for _ in range(60)]
    weights = [1 / (i + 1) ** 2 for i in range(60)]
    texts = [None, "", *(" ".join(x.upper() if r.random() < 0.1 else x for x in r.choices(vocabulary, weights, k=80)) for _ in range(300))]
    spark.createDataFrame([(i, t, "en", "web", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    lower = {i: i + 32 for i in range(65, 91)}
    counts: Counter[str] = Counter()
    for i, t in enumerate(texts):
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = run.translate(lower)
            h = zlib.crc32(f"{i}:{w}".encode())
            if h % 31 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    want = brute(words)
    assert any(x[0] for x in want.values())
    assert got(queries.op11_trie_pair_variants(spark, str(tmp_path))) == want
