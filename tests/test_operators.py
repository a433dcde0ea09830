"""Operators against brute force and their own invariants."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from placegrid.operators import attention, ledger, vectors
from placegrid.operators import places as L
from placegrid.sources import agents, images, plugins
from placegrid.streaming import incremental


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(0)
    return rng.normal(size=(60, 8)).astype(np.float32)


def frames(spark, points):
    q = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(points[:15])], "query long, features array<float>")
    t = spark.createDataFrame([(100 + i, v.tolist()) for i, v in enumerate(points[15:])], "target long, features array<float>")
    return q, t


def nearest(points, k):
    d = ((points[:15, None].astype(float) - points[None, 15:].astype(float)) ** 2).sum(-1)
    return {i: [100 + int(j) for j in np.lexsort((np.arange(45), d[i]))[:k]] for i in range(15)}


def test_knn_matches_brute_force_and_chunks(spark, points):
    q, t = frames(spark, points)
    got = {}
    for r in vectors.knn(q, t, 4, block=4).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["target"])
    assert got == nearest(points, 4)
    halves = [vectors.knn(q, t.where(F.col("target") % 2 == i), 4).drop("rank") for i in (0, 1)]
    again = vectors.top_k(halves[0].unionByName(halves[1]), 4)
    assert again.count() == 60 and again.join(vectors.knn(q, t, 4), ["query", "rank", "target"]).count() == 60


def test_knn_returns_all_references_when_k_is_larger(spark, points):
    q, t = frames(spark, points)
    assert vectors.knn(q, t.limit(3), 10).count() == 45


def test_expansion(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query long, features array<float>")
    t = spark.createDataFrame([(2, [0.0, 1.0])], "target long, features array<float>")
    near = spark.createDataFrame([(1, 1, 2)], "query long, rank int, target long")
    assert np.allclose(vectors.expanded(q, t, near).first()["features"], [0.8, 0.2])
    lost = spark.createDataFrame([(1, 1, 9)], "query long, rank int, target long")
    with pytest.raises(Exception, match="no vector"):
        vectors.expanded(q, t, lost).collect()


def scalar_gem(v, w, alpha, shape, p=3.0, eps=1e-6):
    c, h, k = shape
    x = [[max(v[i * h * k + j], eps) ** p for j in range(h * k)] for i in range(c)]
    if w is None or alpha <= 1e-6:
        return [(sum(r) / (h * k)) ** (1 / p) for r in x]
    contrib = [max(sum(x[i][j] for i in range(c)) / (h * k + eps), eps) ** (1 / p) for j in range(h * k)]
    mean = sum(contrib) / len(contrib) + eps
    final = [q / mean + alpha * (a - q / mean) for q, a in zip(contrib, w, strict=True)]
    return [(sum(f * q for f, q in zip(final, r, strict=True)) / (sum(final) + eps)) ** (1 / p) for r in x]


def test_pooling_matches_a_scalar_version(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.random(24).tolist(), None if i == 3 else (rng.random(12) * 2).tolist(), alpha) for i, alpha in enumerate((0.0, 0.5, 1.0, 0.7))]
    rows += [(9, None, None, 0.5), (10, [1.0], None, 0.5)]
    df = spark.createDataFrame(rows, "id long, v array<double>, w array<double>, alpha double")
    got = {r["id"]: r["pooled"] for r in vectors.pooled(df, "id", "v", (2, 3, 4), "w", "alpha").collect()}
    assert got[9] is None and got[10] is None
    for i, v, w, alpha in rows[:4]:
        assert np.allclose(got[i], scalar_gem(v, w, alpha, (2, 3, 4)))
    plain = {r["id"]: r["pooled"] for r in vectors.pooled(df.select("id", "v"), "id", "v", (2, 3, 4)).collect()}
    assert np.allclose(plain[1], scalar_gem(rows[1][1], None, 0, (2, 3, 4)))


def test_rows_a_search_leaves_out(spark, points):
    q, t = frames(spark, points)
    bad = spark.createDataFrame([(1000, [float("nan")] * 8), (1001, None), (1002, [1.0])], "target long, features array<float>")
    both = t.unionByName(bad)
    assert vectors.knn(q, both, 4, size=8).count() == 60
    assert {tuple(r) for r in vectors.unusable(both, "target", "features", 8).collect()} == {(1000, "nan"), (1001, "null"), (1002, "length")}


def test_radius_join_around_the_globe(spark):
    rng = np.random.default_rng(2)
    base = [(0, 179.999), (0, -179.999), (89.99, 10), (89.99, -170), (-60, 0), (70, 180), (45, -180), (-89.9999, 55)]
    place = [(float(np.clip(a + rng.normal(0, 0.003), -90, 90)), float((b + rng.normal(0, 0.006 / max(math.cos(math.radians(a)), 1e-3)) + 180) % 360 - 180)) for a, b in base for _ in range(8)]
    q = spark.createDataFrame([(i, *p) for i, p in enumerate(place)], "query long, lat double, lon double")
    t = q.withColumnRenamed("query", "target")

    def metres(p, r):
        h = math.sin(math.radians(r[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(r[0])) * math.sin(math.radians(r[1] - p[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    for radius in (150.0, 900.0, 500000.0):
        want = {(i, j) for i, p in enumerate(place) for j, r in enumerate(place) if metres(p, r) <= radius}
        got = [tuple(r) for r in L.radius_join(q, t, radius).select("query", "target").collect()]
        assert len(got) == len(want) and set(got) == want


def test_radius_join_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    a, b = rng.uniform(-0.004, 0.004, (40, 2)), rng.uniform(-0.004, 0.004, (50, 2))
    q = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(a)] + [(99, None, None)], "query long, lat double, lon double")
    t = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "target long, lat double, lon double")

    def metres(p, r):
        h = math.sin(math.radians(r[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(r[0])) * math.sin(math.radians(r[1] - p[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    want = {(i, j) for i, p in enumerate(a) for j, r in enumerate(b) if metres(p, r) <= 150}
    assert {(r["query"], r["target"]) for r in L.radius_join(q, t, 150.0).collect()} == want
    assert L.ground_truth(q, t, 150.0).where("query = 99 and target is null").count() == 1


def test_success(spark):
    found = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (2, 1, 10), (3, 1, 10)], "query long, rank int, target long")
    truth = spark.createDataFrame([(1, 11), (2, None)], "query long, target long")
    got = {r["query"]: (r["success_at_1"], r["success_at_5"]) for r in L.success_at_k(found, truth).collect()}
    assert got == {1: (0, 1), 2: (0, 0)}
    none = L.metrics_long(L.success_rates(L.success_at_k(found.limit(0), truth)), 100.0).collect()
    assert [r["metric"] for r in none] == ["error"]


def maps(spark, texts, ratio=1.0, **options):
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return [(r["attention_status"], r["attention"]) for r in attention.dispatched(rows, 4, 4, F.lit(ratio), **options).orderBy("id").collect()]


def test_dispatch(spark):
    grid = '{"A1":3,"A2":1,"b1":0.5,"B2":"x"}'
    texts = [grid, f'{{"result":{grid}}}', '{"A1":1,"A2":1,"B1":1}', '{"A1":1,"A2":1,"B1":1,"note":2}', '{"result":"[]"}', '{"result":null}', None, "no", "[]", "{}", '{"result":[{"center":[0.5,0.5],"weight":1.5},{"center":[0],"weight":1},{"center":[0,0],"weight":null}]}', "7"]
    got = maps(spark, texts)
    assert [s for s, _ in got] == ["grid", "grid", "fallback", "fallback", "plain", "plain", "plain", "plain", "points", "grid", "points", "plain"]
    assert got[0][1] == got[1][1] == [2, 2, 1, 1] * 2 + [0.5, 0.5, 1, 1] * 2
    assert got[8][1] == got[9][1] == [1] * 16 and np.allclose(got[10][1], 1.5) and got[2][1] is None
    assert {s for s, _ in maps(spark, texts, 1e-7)} == {"plain"}
    smooth = np.array(maps(spark, [grid], interpolate=True)[0][1]).reshape(4, 4)
    assert np.allclose(smooth[0], [2, 1.75, 1.25, 1]) and np.allclose(smooth[:, 0], [2, 1.625, 0.875, 0.5])


def test_point_map_stays_within_weights(spark):
    [(_, w)] = maps(spark, ['[{"center":[0.2,0.3],"weight":0.5},{"center":[0.9,0.1],"weight":1.5}]'])
    assert len(w) == 16 and min(w) >= 0.5 and max(w) <= 1.5 and max(w) - min(w) > 0.5


def test_annotations_join_by_stem(spark):
    q = spark.createDataFrame([("a.b.jpg",), ("c.png",)], "basename string")
    notes = spark.createDataFrame([("a.b.json", "x"), ("z.json", "y")], "filename string, text string")
    assert {tuple(r) for r in attention.annotated(q, notes).select("basename", "text").collect()} == {("a.b.jpg", "x"), ("c.png", None)}


def test_projection(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0])], "id long, v array<double>")
    got = {r["id"]: r["features"] for r in vectors.projected(rows, "id", "v", np.array([[1.0, 1.0], [0.0, 2.0], [1.0, -1.0]]), np.array([0.0, 1.0, 0.0])).collect()}
    assert got == {1: [3.0, 5.0, -1.0], 2: None, 3: None}


def test_ranks_over_many_ranges(spark):
    ids = sorted(int(x) for x in np.random.default_rng(4).choice(100000, 500, replace=False))
    got = ledger.ranked(spark.createDataFrame([(i,) for i in ids], "k long"), "k", 16).orderBy("k").collect()
    assert [(r["k"], r["position"]) for r in got] == [(k, i) for i, k in enumerate(ids)]


def test_rerank_tasks(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")
    found = spark.createDataFrame([("a", 2, "y"), ("a", 1, "x"), ("b", 1, "z")], "query string, rank int, target string")
    done = items.where("item = 'b'")
    tasks = ledger.rerank_tasks(items, found, done, "/r/", 100)
    assert [tuple(r) for r in tasks.collect()] == [("a", ["/r/x", "/r/y"])]
    out = agents.reranked(tasks, "s", agents.stub_chat, "which?").collect()
    assert [(r["item"], r["response"], r["error"]) for r in out] == [("a", "1:6", None)]
    with pytest.raises(Exception, match="no candidates for a"):
        ledger.rerank_tasks(items.limit(1), found.withColumn("target", F.lit(None).cast("string")), done, "/r").collect()


def test_chats(spark):
    turns = spark.createDataFrame([(1, 0, "ab"), (1, 1, "abc"), (2, 0, "a"), (1, 2, None)], "conversation long, turn int, prompt string")
    got = {(r["conversation"], r["turn"]): (r["reply"], r["error"] is None) for r in agents.chatted(turns, "s", agents.stub_chat, "sys").collect()}
    assert got == {(1, 0): ("2:2", True), (1, 1): ("3:3", True), (2, 0): ("2:1", True), (1, 2): (None, False)}
    talk = agents.Conversation("x")
    talk.say("hello", ["u"], agents.stub_chat())
    assert [m["role"] for m in talk.history] == ["system", "user", "assistant"]
    talk.set_system("y")
    assert talk.history == [{"role": "system", "content": "y"}]


def test_retries_and_backoff():
    waits, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 3:
            raise ValueError
        return "ok"

    assert agents.retried(call, 3, waits.append) == "ok" and 0.5 <= waits[0] <= 0.75 and 1 <= waits[1] <= 1.25
    with pytest.raises(ZeroDivisionError):
        agents.retried(lambda: 1 // 0, 2, waits.append)


def test_pacing(spark):
    rows = spark.createDataFrame([(1, s) for s in (0, 1, 2, 50, 400)], "k long, s long").selectExpr("k", "timestamp_seconds(s) as ts")
    got = [r["s"] for r in incremental.paced(rows, "ts", "k", 2).orderBy("start").selectExpr("unix_seconds(start) as s").collect()]
    assert got == [0, 30, 60, 90, 400]
    assert incremental.spacing(rows, "ts", "k", 2).where("early").count() == 2


def test_checkpoints_and_caches(spark, tmp_path):
    main, backup, schema = str(tmp_path / "main"), str(tmp_path / "backup"), "item string, status string"
    rows = spark.createDataFrame([("a", "success")], schema)
    assert ledger.checkpoint(spark, main, backup, schema).count() == 0
    rows.write.parquet(backup)
    assert ledger.checkpoint(spark, main, backup, schema).count() == 0  # without a main one it starts afresh
    (tmp_path / "main").mkdir()
    (tmp_path / "main" / "part.parquet").write_text("broken")
    assert ledger.checkpoint(spark, main, backup, schema).count() == 1
    made = []
    for alpha in (0.5, 0.5, 1.0):
        ledger.cached(spark, str(tmp_path / "cache"), {"alpha": alpha, "k": 5}, lambda: made.append(1) or rows).count()
    assert len(made) == 2
    assert ledger.chunk_size(10**6, 10.0) == 32768 and ledger.chunk_size(3, 10.0) == 3 and ledger.chunk_size(9, 0.0) == 1


def test_named_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("/x/a.jpg", "m", True, True, False, '{"A1":1}'), ("/x/é.jpg", "m", False, False, False, "sorry é"), ("/x/n.png", "m", True, True, True, None)], "image_path string, model string, format_verified boolean, content_verified boolean, no_weighting boolean, result string")
    written = images.put_files(images.annotation_files(rows), f"file://{tmp_path}/notes")
    assert {r["name"] for r in written.collect()} == {"a.json", "é.json", "n.json"}
    import json

    text = (tmp_path / "notes" / "é.json").read_text()
    assert json.loads((tmp_path / "notes" / "a.json").read_text())["result"] == {"A1": 1} and "sorry é" in text and text.startswith('{\n  "image_path"')
    usage = spark.createDataFrame([(5, 2)], "prompt_tokens long, api_calls long")
    images.usage_text(usage, str(tmp_path), "t1")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "usage_t1")).collect()] == ["prompt_tokens: 5", "api_calls: 2"]
    images.timing_csv(spark.createDataFrame([("a", 1.23456)], "filename string, processing_time double"), str(tmp_path / "t"))
    assert spark.read.option("header", True).csv(str(tmp_path / "t")).first().asDict() == {"filename": "a", "processing_time": "1.235"}
    shards = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "path string, features array<float>")
    images.feature_table(shards, str(tmp_path / "f"), 1)
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2


def test_resume_and_retry(spark):
    items = spark.createDataFrame([("a",), ("b",), ("c",)], "item string")

    def work(item):
        if item == "b":
            raise ValueError(item)
        return item.upper()

    first = ledger.attempted(items, work)
    assert {(r["item"], r["status"]) for r in first.collect()} == {("a", "success"), ("b", "failed"), ("c", "success")}
    assert [r["item"] for r in ledger.to_retry(items, first).collect()] == ["b"]
    assert [r["item"] for r in ledger.pending(items, first.where("status = 'success'")).collect()] == ["b"]


def test_outputs_match_whole_stems(spark):
    items = spark.createDataFrame([("img_1.jpg",), ("img_10.jpg",)], "item string")
    outputs = spark.createDataFrame([("img_10_generated_1.png",)], "output string")
    assert [r["item"] for r in ledger.outputs_done(items, outputs).collect()] == ["img_10.jpg"]


def test_sources_and_sinks(spark, tmp_path):
    for n in ("b.JPG", "a.png", "c.txt"):
        (tmp_path / n).write_bytes(n.encode())
    (tmp_path / "list").write_text(" a.png \n\nzz.doc\n")
    assert sorted(r["basename"] for r in images.scan(spark, str(tmp_path)).collect()) == ["a.png", "b.JPG"]
    assert [r["basename"] for r in images.images(spark, str(tmp_path), str(tmp_path / "list")).collect()] == ["a.png"]
    assert images.images(spark, str(tmp_path), str(tmp_path / "missing")).count() == 2
    found = spark.createDataFrame([("q", 1, "t1", -0.5), ("q", 2, "t2", -1.0)], "query string, rank int, target string, score double")
    images.retrieval_json(found).write.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, images.read_retrieval(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, found.collect()))
    images.write_csv(found, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2


def test_annotations_in_any_encoding(spark, tmp_path):
    (tmp_path / "a.json").write_bytes('{"x":"é"}'.encode())
    (tmp_path / "b.json").write_bytes('{"x":"é"}'.encode("latin-1"))
    (tmp_path / "c.json").write_text("nope")
    got = {r["filename"]: (r["text"], r["kind"]) for r in images.annotations(spark, str(tmp_path)).collect()}
    assert got["a.json"] == got["b.json"] == ('{"x":"é"}', "object") and got["c.json"][1] is None


def test_inference_fails_by_row(spark):
    rows = spark.createDataFrame([("a", b"1"), ("b", b""), ("c", b"3")], "path string, content binary")

    def load():
        model = plugins.stub_model(4)

        def run(contents):
            if b"" in contents:
                raise ValueError("unreadable")
            return model(contents)

        return run

    got = {r["path"]: (r["features"], r["error"]) for r in plugins.inferred(rows, load).collect()}
    assert got["b"][0] is None and "unreadable" in got["b"][1] and len(got["a"][0]) == 4 and got["c"][1] is None


def test_stream_takes_only_what_is_new(spark, tmp_path):
    rows = spark.range(10)
    rows.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        incremental.drained(incremental.increments(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / "ck"))
    rows.write.mode("append").parquet(str(tmp_path / "in"))
    incremental.drained(incremental.increments(spark, str(tmp_path / "in"), rows.schema), str(tmp_path / "out"), str(tmp_path / "ck"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20
