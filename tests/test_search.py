"""The pruned search against brute force: pivots, hot cells, copies, ties, large coordinates, what it leaves out and visits."""

from __future__ import annotations

import numpy as np
import pytest

from placegrid.operators import search, vectors
from placegrid.plans import reference


def frame(spark, rows: np.ndarray, name: str, first: int = 0):
    return spark.createDataFrame([(first + i, v.tolist()) for i, v in enumerate(rows)], f"{name} long, features array<double>").repartition(3)


def brute(q: np.ndarray, t: np.ndarray, k: int) -> dict[int, list[int]]:
    out = {}
    for i, a in enumerate(q):
        d2 = ((t - a) ** 2).sum(1)
        out[i] = np.lexsort((np.arange(len(t)), d2))[:k].tolist()
    return out


def got(rows) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["query"], r["rank"])):
        out.setdefault(r["query"], []).append(r["target"])
    return out


def clustered(seed: int, n: int, size: int, spread: float = 0.05) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return rng.normal(0, 3, (12, size))[rng.integers(0, 12, n)] + rng.normal(0, spread, (n, size))


@pytest.mark.parametrize("small", [0, 1 << 30])
@pytest.mark.parametrize(("shift", "scale"), [(0.0, 1.0), (8e6, 1e-3), (1e8, 1e-2)])
def test_equals_brute_force_at_any_norm(spark, small: int, shift: float, scale: float) -> None:
    t = clustered(1, 700, 6) * scale + shift
    q = clustered(1, 40, 6, 0.07) * scale + shift
    assert got(search.knn(frame(spark, q, "query"), frame(spark, t, "target"), 5, block=32, small=small)) == brute(q, t, 5)


def test_copies_and_ties(spark) -> None:
    """A third of the references are one vector, in far more blocks than one; ties are broken by key."""
    t = np.vstack([np.ones((200, 4)), np.random.default_rng(2).integers(0, 3, (400, 4)).astype(float)])
    q = np.vstack([np.ones((3, 4)), np.random.default_rng(3).integers(0, 3, (20, 4)).astype(float)])
    assert got(search.knn(frame(spark, q, "query"), frame(spark, t, "target"), 7, block=16, small=0)) == brute(q, t, 7)


def test_fewer_references_than_k_and_none(spark) -> None:
    t, q = clustered(4, 9, 3), clustered(5, 4, 3)
    assert got(search.knn(frame(spark, q, "query"), frame(spark, t, "target"), 20, block=2, small=0)) == brute(q, t, 20)
    empty = frame(spark, t, "target").where("target < 0")
    assert search.knn(frame(spark, q, "query"), empty, 3).count() == 0
    assert search.knn(frame(spark, q, "query").where("query < 0"), frame(spark, t, "target"), 3, block=2, small=0).count() == 0


@pytest.mark.parametrize("small", [0, 1 << 30])
def test_unusable_rows_are_left_out_and_reported(spark, small: int) -> None:
    t, q = clustered(6, 50, 3), clustered(7, 5, 3)
    bad = spark.createDataFrame([(1000, [float("nan")] * 3), (1001, None), (1002, [1.0]), (1003, [1.0, None, 2.0]), (1004, [float("inf"), 0.0, 0.0])], "target long, features array<double>")
    both = frame(spark, t, "target").unionByName(bad)
    asking = frame(spark, q, "query").unionByName(bad.withColumnRenamed("target", "query"))
    assert got(search.knn(asking, both, 4, block=8, small=small)) == brute(q, t, 4)
    assert {r[0] for r in vectors.unusable(both, "target", "features", 3).collect()} >= {1000, 1001, 1002, 1003}


def test_visits_fewer_pairs_and_joins_nothing_whole(spark, capsys) -> None:
    t, q = clustered(8, 2000, 4), clustered(8, 60, 4, 0.05)
    seen = search.visits(frame(spark, q, "query"), frame(spark, t, "target"), 5, block=32).first()
    assert seen["queries"] == 60 and seen["blocks"] >= 2000 / 32 and seen["visited"] < 0.35 * 60 * seen["blocks"], seen
    search.knn(frame(spark, q, "query"), frame(spark, t, "target"), 5, block=32, small=0).explain()
    assert "Cartesian" not in capsys.readouterr().out


@pytest.mark.parametrize(("shift", "scale"), [(0.0, 1.0), (8e6, 1 / 64)])
def test_no_row_for_a_query_and_a_block(spark, monkeypatch, shift: float, scale: float) -> None:
    """Vectors without structure leave nearly all blocks to be visited; tables between the rounds grow with the queries only."""
    rng, rows, write = np.random.default_rng(9), [], search.written
    t, q = rng.normal(0, 1, (3000, 24)) * scale + shift, rng.normal(0, 1, (200, 24)) * scale + shift

    def counted(df):
        out = write(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(search, "written", counted)
    monkeypatch.setattr(search, "TILE", 1 << 16, raising=False)  # many tiles and packs
    assert got(search.knn(frame(spark, q, "query"), frame(spark, t, "target"), 5, block=8, small=0)) == brute(q, t, 5)
    assert max(rows) <= 10 * len(q), rows


def test_within_a_label(spark, monkeypatch) -> None:
    """The nearest of a query's own label, without a row for each of its candidates; labels may be missing or have no references."""
    monkeypatch.setattr(search, "TILE", 1 << 13)  # labels of several tiles and packs
    rng = np.random.default_rng(10)
    t, q = rng.integers(0, 4, (1500, 3)).astype(float), rng.integers(0, 4, (150, 3)).astype(float)
    label = lambda i: None if i % 11 == 0 else i % 3 if i % 5 else 0
    of = lambda rows, name, only: spark.createDataFrame([(i, v.tolist(), label(i) if only is None or label(i) != only else 77) for i, v in enumerate(rows)], f"{name} long, features array<float>, label int").repartition(3)
    found = got(search.knn_within(of(q, "query", 2), of(t, "target", None), 4, "label"))
    want = {}
    for i, a in enumerate(q):
        own = [j for j in range(len(t)) if label(j) == label(i)] if label(i) in (0, 1) else []
        if own:
            want[i] = sorted(own, key=lambda j: (((t[j] - a) ** 2).sum(), j))[:4]
    assert found == want


def test_candidates_of_a_label_are_never_paired(spark, tmp_path, monkeypatch) -> None:
    """The query on one label that all share: Spark's joins make a row for a pack of queries and a tile, not for a pair."""
    rng = np.random.default_rng(11)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(rng.normal(0, 1, (2000, 4)))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    made, meet = [], search.met
    monkeypatch.setattr(search, "met", lambda *a: (made.append((out := meet(*a)).count()), out)[1])
    got_ = reference.knn_candidate_rerank(spark, str(tmp_path)).collect()
    assert made and sum(made) < 1000 and len(got_) == 200 * 5  # of 360,000 pairs
