"""The bounded sample of labelled documents against a greedy one in plain Python."""

from __future__ import annotations

from placegrid.llm import hashed


def test_sample_fills_its_bounds(spark):
    rows = [(i, "x" * (900 if i % 3 == 0 else 5 + i % 7)) for i in range(120)] + [(500, None), (501, "y" * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)] + [(5, 0)], "doc_id long, quality int")
    rank = {r["doc_id"]: r["h"] for r in docs.selectExpr("doc_id", "xxhash64(doc_id, 7) as h").collect()}
    for most, size in ((40, 10**6), (200, 10**6), (200, 2000), (40, 1500), (3, 950)):
        want, total = [], 0
        for i, t in sorted(rows, key=lambda r: rank[r[0]]):
            if t is not None and len(want) < most and total + len(t) <= size:
                want.append(i)
                total += len(t)
        got = hashed.sample(docs, labels, "quality", most, size)
        assert got["doc_id"].tolist() == want
    assert hashed.sample(docs, labels.limit(0), "quality", 5, 100).empty and hashed.sample(docs.limit(0), labels, "quality", 5, 100).empty
