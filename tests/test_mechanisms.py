"""Positions, generations, second chances, resumable and stateful streams, files, batched inference, usage and table functions."""

from __future__ import annotations

import json
import os
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from placegrid.functions import tables
from placegrid.operators import attention, generations, ledger, observed, positions, secondchance
from placegrid.sources import batched, files, plugins
from placegrid.streaming import incremental, limits, resumable

# Positions


@pytest.mark.parametrize("ranges", [1, 5])
def test_positions_of_any_keys(spark, ranges: int) -> None:
    r = random.Random(1)
    rows = [(r.choice([None, "", "a/b", "a b", "Ä", "z" * 50, "/db/1.jpg"]) if r.random() < 0.5 else f"/db/{r.randrange(10**9)}.jpg", r.choice([7, None, 2**62, -(2**62)]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "position string, id long, m int").repartition(4)
    got = sorted(positions.numbered(df, "position", "id", "m", ranges=ranges, name="p").collect(), key=lambda x: x["p"])
    assert [x["p"] for x in got] == list(range(400))
    key = lambda x: (x[0] is not None, (x[0] or "").encode(), x[1] is not None, x[1] or 0, x[2])
    assert [tuple(x)[:3] for x in got] == sorted(rows, key=key)


def test_positions_of_repeated_rows(spark) -> None:
    df = spark.createDataFrame([("same",)] * 300 + [("t",)], "k string").repartition(3)
    got = positions.numbered(df, "k", ranges=4).collect()
    assert sorted(x["position"] for x in got) == list(range(301)) and {x["position"] for x in got if x["k"] == "t"} == {300}
    batches = positions.batched(df, "k", size=100).groupBy("batch").count().collect()
    assert {tuple(b) for b in batches} == {("000000", 100), ("000001", 100), ("000002", 100), ("000003", 1)}
    assert positions.numbered(df.limit(0), "k").count() == 0


# Ledgers


def test_latest_does_not_depend_on_the_order_of_rows(spark) -> None:
    rows = [("a", 1, "failed", {"k": "v"}), ("a", 1, "success", None), ("b", 2, "x", None), ("b", None, "y", None), (None, 1, "n", None)]
    schema = "item string, attempt int, status string, more map<string,string>"
    for some in (rows, rows[::-1]):
        assert {tuple(r)[:3] for r in ledger.latest(spark.createDataFrame(some, schema).coalesce(1)).collect()} == {("a", 1, "failed"), ("b", 2, "x"), (None, 1, "n")}


def saved(spark, base: str):
    rows = spark.createDataFrame([(f"i{n}", n % 3, None if n % 5 else "x") for n in range(200)], "item string, attempt int, result string").repartition(4)
    first = generations.saved(rows.where("attempt < 2"), base, note="first")
    return rows, first, generations.saved(rows, base)


def test_generations_are_numbered_and_loaded(spark, tmp_path) -> None:
    base = f"file://{tmp_path}/ledger"
    assert generations.loaded(spark, base, "item string").count() == 0 and generations.newest(spark, base) is None
    rows, first, second = saved(spark, base)
    assert (first.number, second.number, first.more) == (0, 1, {"note": "first"})
    assert generations.newest(spark, base) == second
    assert sorted(map(tuple, generations.loaded(spark, base, rows.schema).collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    empty = generations.saved(rows.limit(0), base)
    assert generations.newest(spark, base) == empty and generations.loaded(spark, base, rows.schema).count() == 0
    assert generations.pruned(spark, base, keep=2) == [0] and generations.manifests(spark, base) == [2, 1]


@pytest.mark.parametrize("harm", ["truncate", "delete", "add", "flip", "manifest"])
def test_any_damage_of_any_file_falls_back(spark, tmp_path, harm: str) -> None:
    base = f"file://{tmp_path}/ledger"
    rows, first, second = saved(spark, base)
    folder = second.folder.removeprefix("file://")
    for name in sorted(second.files):
        path, kept = f"{folder}/{name}", open(f"{folder}/{name}", "rb").read()
        if harm == "truncate":
            open(path, "wb").write(kept[: len(kept) // 2])
        elif harm == "delete":
            os.remove(path)
        elif harm == "add":
            open(f"{folder}/part-99999-more.parquet", "wb").write(kept)
        elif harm == "flip":  # the same size, other values: another file of the same rows with one cell changed
            at = kept.index(b"i1")
            open(path, "wb").write(kept[:at] + b"j" + kept[at + 1 :])
        else:
            path = f"{base.removeprefix('file://')}/manifests/{second.number:09d}.json"
            kept = open(path, "rb").read()
            open(path, "wb").write(kept[:-20])
        for f in os.listdir(folder):  # checksums of the local file system would notice, others have none
            if f.endswith(".crc"):
                os.remove(f"{folder}/{f}")
        manifest_crc = f"{base.removeprefix('file://')}/manifests/.{second.number:09d}.json.crc"
        if os.path.exists(manifest_crc):
            os.remove(manifest_crc)
        assert generations.newest(spark, base) == first, name
        open(path, "wb").write(kept)
        if harm == "add":
            os.remove(f"{folder}/part-99999-more.parquet")
        assert generations.newest(spark, base) == second
    for name in first.files:
        os.remove(f"{first.folder.removeprefix('file://')}/{name}")
    for name in second.files:
        os.remove(f"{folder}/{name}")
    with pytest.raises(generations.DamagedError):
        generations.loaded(spark, base, rows.schema)


def test_a_number_is_published_once(spark, tmp_path) -> None:
    path = f"file://{tmp_path}/manifests/000000007.json"
    assert generations.published(spark, path, "a") and not generations.published(spark, path, "b")
    assert generations.read_text(spark, path) == "a" and len([f for f in os.listdir(tmp_path / "manifests") if not f.endswith(".crc")]) == 1


def test_checkpoint_reads_all_of_the_main_one(spark, tmp_path) -> None:
    main, backup, schema = str(tmp_path / "main"), str(tmp_path / "backup"), "item string, status string"
    rows = spark.createDataFrame([(f"i{n}", "success") for n in range(40)], schema).repartition(4)
    rows.write.parquet(main)
    rows.limit(3).write.parquet(backup)
    part = sorted(f for f in os.listdir(main) if f.endswith(".parquet"))[-1]
    data = open(f"{main}/{part}", "rb").read()
    open(f"{main}/{part}", "wb").write(data[: len(data) // 2])
    os.remove(f"{main}/.{part}.crc")
    assert ledger.checkpoint(spark, main, backup, schema).count() == 3
    for f in os.listdir(backup):
        if f.endswith(".parquet"):
            open(f"{backup}/{f}", "wb").write(b"no")
            os.remove(f"{backup}/.{f}.crc")
    with pytest.raises(Exception, match="."):
        ledger.checkpoint(spark, main, backup, schema)


def test_cached_writes_again_what_a_failed_write_left(spark, tmp_path) -> None:
    rows, made = spark.range(5), []
    ledger.cached(spark, str(tmp_path), {"a": 1}, lambda: made.append(1) or rows)
    [folder] = [f for f in os.listdir(tmp_path)]
    for f in os.listdir(tmp_path / folder):
        os.remove(tmp_path / folder / f)
    assert ledger.cached(spark, str(tmp_path), {"a": 1}, lambda: made.append(1) or rows).count() == 5 and len(made) == 2


# Second chances


def test_broken_replies_are_asked_once_and_parsed_once(spark, tmp_path) -> None:
    texts = [None, " NONE ", '{"A1":1}', "[1", "[1", "[1", "{'a':[1,2", "no bracket", '```json\n[{"center":[0.5,0.5],"weight":1,"reasoning":"x"}\n```', "fail {"]
    rows = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "id int, text string, broken string").repartition(3)
    log = str(tmp_path / "asked")

    def load():
        chat = secondchance.mending_model()

        def run(messages):
            with open(log, "a") as f:
                f.write(json.dumps(messages[-1]["content"][-1]["text"]) + "\n")
            if "fail" in messages[-1]["content"][-1]["text"]:
                raise OverflowError("model")
            return chat(messages)

        return run

    got = {r["id"]: r for r in secondchance.repaired_by_model(rows, "text", f"m{log}", load).collect()}
    asked = [json.loads(x) for x in open(log)]
    assert len(asked) == len(set(asked)) == 5 and all(x.startswith(secondchance.PROMPT + "\n") for x in asked)
    assert [(got[i]["result"], got[i]["format_verified"], got[i]["content_verified"], got[i]["no_weighting"], got[i]["mended"]) for i in range(10)] == [
        (None, False, False, False, False), (None, True, True, True, False), ('{"A1":1}', False, False, False, False), *[("[1]", True, False, False, True)] * 3, ('{"a":[1,2]}', False, False, False, True),
        (None, False, False, False, False), ('[{"center":[0.5,0.5]}]', True, False, False, True), (None, False, False, False, False),
    ]
    assert "no JSON" in got[7]["model_error"] and "OverflowError" in got[9]["model_error"] and got[3]["broken"] == "c"
    answers = spark.createDataFrame([(0, "{'matches': [{'image_number': 1, 'confidence': 'low'"), (1, "nothing"), (2, "None"), (3, '{"matches":null}')], "id int, text string")
    top = {r["id"]: r for r in secondchance.top100_mended(answers, "text", "mend", secondchance.mending_model).collect()}
    assert [(top[i]["format_verified"], top[i]["content_verified"], top[i]["original"], top[i]["mended"]) for i in range(4)] == [(True, True, None, True), (False, False, "nothing", False), (False, False, "None", False), (True, True, None, False)]
    assert secondchance.repaired_by_model(rows.limit(0), "text", "mend", secondchance.mending_model).count() == 0


# Attention by files


def test_annotation_files(spark) -> None:
    q = spark.createDataFrame([("a.jpg",), ("b.jpg",)], "basename string")
    notes = spark.createDataFrame([("a.json", '{"result":[]}'), ("a.jsonx", '{"result":7}'), ("a.json", '{"result":{}}'), ("b.json", '{"A1":2}')], "filename string, text string")
    joined = attention.annotated(q, notes)
    assert joined.count() == 2
    for wrapped, want in ((True, {"a.jpg": "points", "b.jpg": "plain"}), (False, {"a.jpg": "points", "b.jpg": "grid"})):
        assert {r["basename"]: r["attention_status"] for r in attention.dispatched(joined, 4, 4, F.lit(1.0), wrapped=wrapped).collect()} == want


# Streams


def flaky(item: str) -> str:
    if item.endswith("7"):
        raise ValueError(item)
    return item.upper()


def ledger_rows(rows) -> list[tuple]:
    return sorted((r["item"], r["status"], r["result"], r["attempt"]) for r in rows.collect())


def test_a_killed_run_gives_the_same_ledger(spark, tmp_path, monkeypatch) -> None:
    for n, part in enumerate((range(0, 20), range(15, 40))):
        spark.createDataFrame([(f"i{x}",) for x in part] + [(None,)], "item string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in{n}")
    source = lambda: incremental.increments(spark, f"file://{tmp_path}/in*", "item string", 1)
    plain = resumable.resumed(source(), f"file://{tmp_path}/a", f"file://{tmp_path}/ca", flaky)
    want = ledger_rows(plain)
    assert len([r for r in want if r[1] == "success"]) == 36 and {r[0] for r in want} == {f"i{x}" for x in range(40)}
    real = resumable.published
    for moment in ("before", "after"):
        base, checkpoint = f"file://{tmp_path}/{moment}", f"file://{tmp_path}/c{moment}"

        def killed(spark_, path, text, moment=moment):
            if moment == "after":
                real(spark_, path, text)
            raise OSError("killed")

        monkeypatch.setattr(resumable, "published", killed)
        with pytest.raises(Exception, match="killed"):
            resumable.resumed(source(), base, checkpoint, flaky)
        monkeypatch.setattr(resumable, "published", real)
        first = ledger_rows(resumable.attempts(spark, base))
        assert bool(first) == (moment == "after")
        again = resumable.resumed(source(), base, checkpoint, flaky)
        assert ledger_rows(ledger.latest(again).where("status = 'success'")) == [r for r in want if r[1] == "success"]
        counts = again.groupBy("item", "attempt").count().where("count > 1")
        assert counts.count() == 0
    later = resumable.resumed(source(), f"file://{tmp_path}/a", f"file://{tmp_path}/ca", str.lower)  # nothing new: what failed is retried
    assert {r[1] for r in ledger_rows(ledger.latest(later))} == {"success"} and {r[3] for r in ledger_rows(ledger.latest(later)) if r[0].endswith("7")} == {2, 3}  # one of them arrived twice
    g = resumable.compacted(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/g")
    assert generations.newest(spark, f"file://{tmp_path}/g") == g and sum(f["rows"] for f in g.files.values()) == 40


def test_stateful_spacing_equals_the_batch(spark, tmp_path) -> None:
    r = random.Random(3)
    rows = [(f"u{r.randrange(6)}", 1_700_000_000_000_000 + r.randrange(200_000_000)) for _ in range(400)]
    calls = spark.createDataFrame(rows, "user string, us long").select("user", F.timestamp_micros("us").alias("ts"))
    calls.repartition(4).write.parquet(f"file://{tmp_path}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", limits.STATE_STORE)
    try:
        for step in (0, 1):
            if step:
                spark.createDataFrame([("end", 1_900_000_000_000_000)], "user string, us long").select("user", F.timestamp_micros("us").alias("ts")).write.mode("append").parquet(f"file://{tmp_path}/in")
            stream = limits.spaced(incremental.increments(spark, f"file://{tmp_path}/in", calls.schema, 1), "ts", "user", 30, "1 hour")
            incremental.drained(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/check")
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.schema("key string, ts timestamp, gap_s double, early boolean").parquet(f"file://{tmp_path}/out").where("key <> 'end'")
    want = incremental.spacing(calls, "ts", "user", 30)
    tidy = lambda d, k: sorted((x[k], x["ts"], -1 if x["gap_s"] is None or pd.isna(x["gap_s"]) else round(x["gap_s"], 6), x["early"]) for x in d.collect())
    assert tidy(out, "key") == tidy(want, "user")


def test_state_of_calls_grows_with_portions() -> None:
    """A portion of many calls of many keys is one value and one timer; late portions, keys seen before and null keys included."""
    class State:
        def __init__(self) -> None:
            self.rows: list = []

        exists = lambda self: bool(self.rows)
        get = lambda self: iter(self.rows) if self.many else self.rows[0]
        appendList = lambda self, rows: self.rows.extend(rows)  # noqa: E731, N815

        def put(self, rows) -> None:
            self.rows = list(rows)

        def update(self, row) -> None:
            self.rows = [row]

        def clear(self) -> None:
            self.rows = []

    class Handle:
        def __init__(self) -> None:
            self.timers, self.states = [], {}

        def state(self, name, many):
            self.states[name] = State()
            self.states[name].many = many
            return self.states[name]

        getListState = lambda self, name, schema: self.state(name, True)  # noqa: E731, N815
        getValueState = lambda self, name, schema: self.state(name, False)  # noqa: E731, N815
        registerTimer = lambda self, ms: self.timers.append(ms)  # noqa: E731, N815

    class Clock:
        getCurrentWatermarkInMs = lambda self: self.ms  # noqa: E731, N815

    r, handle, clock, spacing, got, calls = random.Random(4), Handle(), Clock(), limits.Spacing(500_000), [], []
    spacing.init(handle)
    for portion, ms in enumerate((-1, 40_000, 70_000, 200_000)):
        new = pd.DataFrame([(r.choice([None, *"abcdefgh"]), r.randrange(max(ms, 0) * 1000 + 1, 100_000_000)) for _ in range(300 if portion < 3 else 0)], columns=["key", "us"])
        calls += new.itertuples(index=False, name=None)
        values = len(handle.states["waiting"].rows)
        clock.ms = ms
        list(spacing.handleInputRows((7,), iter([new]), clock))
        assert len(handle.states["waiting"].rows) - values <= 1 and len(handle.timers) <= 2 * portion + 1
        for t in sorted(t for t in handle.timers if t <= ms):
            handle.timers.remove(t)
            got += [x for b in spacing.handleExpiredTimer((7,), clock, None) for x in b[["key", "us", "gap_s", "early"]].itertuples(index=False, name=None)]
    want, last = [], {}
    for key, us in sorted(calls, key=lambda c: c[1]):
        gap = us - last[key] if key in last else None
        want.append((key, us, None if gap is None else gap / 1e6, gap is not None and gap < 500_000))
        last[key] = us
    tidy = lambda rows: sorted((str(k), u, -1 if g is None or pd.isna(g) else g, bool(e)) for k, u, g, e in rows)
    assert len(got) == 900 and tidy((None if pd.isna(k) else k, *x) for k, *x in got) == tidy(want)


# Files


def test_files_are_read_by_what_their_names_tell(spark, tmp_path, monkeypatch) -> None:
    for name, data in (("a.JPG", b"1"), ("b.json", "é".encode()), ("c.json", "é".encode("latin-1")), ("d.txt", b""), ("e", b"x" * 10)):
        (tmp_path / name).write_bytes(data)
    (tmp_path / "sub").mkdir()
    files.registered(spark)
    read = lambda **o: spark.read.format("smallfiles").options(path=str(tmp_path), **o).load()
    assert {(r["basename"], r["suffix"], r["bytes"]) for r in read().select("basename", "suffix", "bytes").collect()} == {("a.JPG", "jpg", 1), ("b.json", "json", 2), ("c.json", "json", 1), ("d.txt", "txt", 0), ("e", "", 10)}
    assert {(r["basename"], r["text"]) for r in read(suffixes="json").collect()} == {("b.json", "é"), ("c.json", "é")}
    (tmp_path / "d.txt").chmod(0)
    reader = files.Reader({"path": str(tmp_path)}, spark.createDataFrame([], files.SCHEMA).schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull

    rest = list(reader.pushFilters([EqualTo(("suffix",), "json"), GreaterThan(("bytes",), 1), IsNotNull(("text",))]))
    assert [type(f).__name__ for f in rest] == ["IsNotNull"] and [f.path.rpartition("/")[2] for f in reader.files()] == ["b.json"]
    assert [r["basename"] for r in read().where("suffix = 'json' and bytes > 1").collect()] == ["b.json"]
    (tmp_path / "list.txt").write_text("a.JPG\n\n c.json \nmissing.jpg\n")
    assert {r["basename"] for r in read(listing=str(tmp_path / "list.txt")).select("basename").collect()} == {"a.JPG", "c.json"}
    assert read(listing=str(tmp_path / "none.txt"), suffixes="jpg").count() == 1
    assert spark.read.format("smallfiles").option("path", str(tmp_path / "nowhere")).load().count() == 0


def test_files_are_written_all_or_nothing(spark, tmp_path) -> None:
    files.registered(spark)
    folder = tmp_path / "out"
    rows = spark.createDataFrame([(f"{i}.json", b"%d" % i, 1) for i in range(30)] + [("none.json", None, 1), (None, b"x", 1)], "name string, content binary, more int").repartition(4)
    write = lambda d: d.write.format("smallfiles").mode("append").option("path", str(folder)).save()
    write(rows)
    assert sorted(os.listdir(folder)) == sorted(f"{i}.json" for i in range(30)) and (folder / "7.json").read_bytes() == b"7"
    for bad in (rows.withColumn("name", F.concat(F.lit("x"), "name")).unionByName(rows.limit(1).withColumn("name", F.lit("no/name"))), rows.withColumn("name", F.lit("twice"))):
        with pytest.raises(Exception, match="name"):
            write(bad)
        assert sorted(f for f in os.listdir(folder) if f != "_staging") == sorted(f"{i}.json" for i in range(30))


# Models, usage, table functions


def test_batched_inference_equals_row_by_row(spark) -> None:
    def load():
        def model(contents):
            if len(contents) > 3:
                raise MemoryError("out of memory")
            if b"bad" in contents:
                raise ValueError("bad")
            return [[float(len(c)), 0.5] for c in contents]

        return model

    rows = spark.createDataFrame([(f"p{i}", b"bad" if i % 7 == 3 else b"x" * i) for i in range(25)], "path string, content binary").repartition(2)
    tidy = lambda d: sorted((r["path"], None if r["features"] is None else list(r["features"]), r["error"]) for r in d.collect())
    assert tidy(batched.predicted(rows, load, 8)) == tidy(plugins.inferred(rows, load, 8, "m"))
    packed = spark.createDataFrame([([1.0, 2.5],), (None,)], "v array<float>").select(batched.packed(F.col("v")).alias("v")).collect()
    assert [None if r["v"] is None else np.frombuffer(r["v"], "<f4").tolist() for r in packed] == [[1.0, 2.5], None]


def test_usage_is_counted_by_the_writing_pass(spark, tmp_path) -> None:
    rows = spark.createDataFrame([("success", 3), ("failed", None), (None, 4)], "status string, total_tokens int")
    got = observed.written_with_usage(rows, f"file://{tmp_path}/a", ("total_tokens",))
    assert got == {"rows": 3, "failed": 2, "total_tokens": 7} and spark.read.parquet(f"file://{tmp_path}/a").count() == 3
    assert observed.written_with_usage(rows.limit(0), f"file://{tmp_path}/b", ("total_tokens",)) == {"rows": 0, "failed": 0, "total_tokens": 0}
    assert observed.checked_copy(rows, f"file://{tmp_path}/c", 4) == {"expected": 4, "found": 3, "complete": False}


def test_table_functions(spark) -> None:
    tables.registered(spark)
    rows = spark.createDataFrame([(1, " see {IMAGE_0} and {IMAGE_1-3} x"), (2, None), (3, "")], "id int, t string")
    got = spark.sql("SELECT d.id, p.* FROM {d} d, LATERAL prompt_parts(d.t, 3) p ORDER BY id, pos", d=rows).collect()
    assert [(r["id"], r["kind"], r["value"]) for r in got] == [(1, "text", "see"), (1, "image", "0"), (1, "text", "and"), (1, "image", "1"), (1, "image", "2"), (1, "text", "x")]
    grids = spark.createDataFrame([(1, '{"A1":true,"A2":"7","B1":"x","note":1}'), (2, "[]"), (3, "no"), (4, None)], "id int, t string")
    cells = spark.sql("SELECT d.id, c.* FROM {d} d, LATERAL grid_cells(d.t, 2) c ORDER BY row, col", d=grids).collect()
    assert [(r["id"], r["w"]) for r in cells] == [(1, 1.0), (1, 2.0), (1, 1.0), (1, 1.0)]
    assert np.isfinite([r["w"] for r in cells]).all()
