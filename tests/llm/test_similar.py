"""Near copies of five-word Jaccard similarity 0.8 or more, against brute force and in the pipeline."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from placegrid.llm import similar
from tests.llm.test_corpus import labelled  # noqa: F401


def brute(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("aeiounrst"), 6)) for _ in range(500)]
    rows = []
    for i in range(60):
        text = list(rng.choice(words, int(rng.integers(30, 300))))
        rows.append(" ".join(text))
        for n in range(int(rng.integers(0, 5))):  # copies of copies, about 0.7 to 1
            for at in rng.integers(0, len(text), int(len(text) * 0.007 * (n + 1))):
                text[at] = str(rng.choice(words))
            rows.append(" ".join(text))
    rows += [rows[0], "one two", "ONE two", "", None, " \n"]
    sets, label = [brute(t) for t in rows], list(range(len(rows)))
    near = 0
    for i in range(len(rows)):
        for j in range(i):
            share = len(sets[i] & sets[j]) / len(sets[i] | sets[j]) if sets[i] | sets[j] else 1
            if share >= 0.8:
                near += share < 0.95
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for i, c in enumerate(label):
        least[c] = min(least.get(c, i), i)
    docs = spark.createDataFrame([*enumerate(rows), (3, rows[3]), (None, rows[3])], "doc_id long, text string").repartition(3)
    got = [r["doc_id"] for r in similar.one_of_each(docs).collect()]
    assert near > 20 and sorted(got, key=lambda x: (x is None, x)) == [*sorted(least.values()), None]
    assert similar.one_of_each(docs.limit(0)).count() == 0


def test_pairs_across_groups(spark):
    rng = np.random.default_rng(12)
    rows, sets = [], {}
    for k in range(3):
        base = np.unique(rng.integers(0, 1 << 63, 60, dtype=np.uint64))
        other = rng.integers(0, 1 << 63, 30, dtype=np.uint64)  # edits come from few grams, so members share them too
        for n in range(70):
            drop = int(rng.integers(0, 16))
            own = np.unique(np.r_[rng.permutation(base)[drop:], rng.permutation(other)[: int(rng.integers(0, drop + 1))]])
            at = similar.node(own)
            sets[at] = own
            rows.append((k, at, similar.majority(own), len(own), int(rng.integers(0, 3))))
    by_node = {r[1]: r for r in rows}
    rows = list(by_node.values())
    alike = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[4] != b[4] and similar.alike(sets[a[1]], sets[b[1]])}
    far = lambda x, y: ((x ^ y) % (1 << 64)).bit_count()
    want = {(a, b) for a, b in alike if by_node[a][0] == by_node[b][0] and far(by_node[a][2], by_node[b][2]) <= similar.RADIUS}
    held = spark.createDataFrame([(n, own.tobytes()) for n, own in sets.items()], "node long, grams binary")
    found = similar.across(spark.createDataFrame(rows, "key long, node long, fp long, size int, label long"), held)
    pairs = [tuple(r) for r in found.collect()]
    assert len(pairs) == len(set(pairs)) and all(by_node[a][4] != by_node[b][4] for a, b in pairs)
    got = {tuple(r) for r in similar.checked(found, held).collect()}
    assert len(want) > 300 and want <= got <= alike


def test_pipeline_drops_similar(spark, tmp_path, labelled):  # noqa: F811
    import corpus_pipeline

    docs, labels = labelled
    good = docs.where("doc_id % 4 <> 0 and doc_id < 120")
    head = lambda n: F.array_join(F.slice(F.split("text", " "), 1, 40 - n), " ")
    near = [good.select((F.col("doc_id") + 1000 * (n + 1)).alias("doc_id"), head(n).alias("text")) for n in (2, 4, 7)]  # 0.94, 0.89, 0.81
    both = docs.unionByName(near[0]).unionByName(near[1]).unionByName(near[2])
    both.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()}
    assert ids == {i for i in range(400) if i % 4}


def test_trees_find_what_all_pairs_would(monkeypatch):
    rng, searched = np.random.default_rng(13), []
    hits = similar.tree_hits

    def counted(fps, child, q, root, radius):
        searched.append(radius)
        return hits(fps, child, q, root, radius)

    monkeypatch.setattr(similar, "tree_hits", counted)
    monkeypatch.setattr(similar, "AT_ONCE", 50)
    n = 400
    few = rng.integers(0, 1 << 63, 60)  # sets of equal fingerprints are in one tree node
    part = pd.DataFrame({"key": rng.integers(0, 5, n), "fp": rng.choice(few, n), "label": rng.integers(0, 4, n), "size": rng.integers(20, 40, n), "at": rng.integers(1, 9, n), "asks": rng.random(n) < 0.5})
    part = part.sort_values(["key", "fp"], ignore_index=True)
    got = [(int(x), int(y)) for a, b in similar.tree_pairs(part) for x, y in zip(a, b, strict=True)]
    rows = list(part.itertuples(index=False))
    want = set()
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            near = (int(a.fp) ^ int(b.fp)).bit_count() <= similar.RADIUS and 5 * min(a.size, b.size) >= 4 * max(a.size, b.size)
            left = 1 + min(a.size - a.at, b.size - b.at)
            if a.asks and a.key == b.key and a.label != b.label and near and 9 * left >= 4 * (a.size + b.size):
                want.add((i, j))
    assert len(want) > 200 and len(got) == len(set(got)) and set(got) == want and searched == [similar.RADIUS]
