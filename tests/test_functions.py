"""One row a branch for the column functions; expectations worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from placegrid.functions import jsonclean as J
from placegrid.functions import paths as P
from placegrid.functions import prompts
from placegrid.plans import reference


def evaluated(spark, column, values, name="v"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_dash_coordinates(spark):
    names = ["37.761_-122.415@x.jpg", "n_33%22.25_114.17@2023@60.jpg", "91.0_10.0@x.jpg", "bad.jpg", "37.761_-122.415", None, "", "nan_1@x.jpg"]
    got = [(r["lat"], r["lon"]) for r in evaluated(spark, P.dash_coordinates(F.col("v")), names)]
    assert got == [(37.761, -122.415), (22.25, 114.17), (None, None), (None, None), (37.761, -122.0), (None, None), (None, None), (None, None)]


def test_parse_coordinates(spark):
    names = ["@1@2@10@S@37.7@-122.5@h@@.jpg", "0543331.40@4179325.38@10@S@037.76022@-122.50806.json", "@1@2@10@S@37.7@-122.5.jpg", "x", None]
    got = [(r["lat"], r["lon"]) for r in evaluated(spark, P.parse_coordinates(F.col("v")), names)]
    assert got == [(37.7, -122.5), (37.76022, -122.50806), (None, None), (None, None), (None, None)]


def test_place_id_rejects_unknown_forms():
    with pytest.raises(ValueError):
        P.place_id("other", None)


def test_clean_initial(spark):
    texts = ['```json\n{"A1":1,}\n```', " none ", 'x [1] {"a":2}', "None", "```\nNone\n```", '{"a":[1]}', None]
    assert evaluated(spark, J.clean_initial(F.col("v")), texts) == ['{"A1":1}', "None", "[1]", "None", "None", '{"a":[1]}', None]


def test_patch_grid(spark):
    [got] = evaluated(spark, J.patch_grid(J.as_map(F.col("v"))), ['{"A1":3,"B2":"x","C3":-1,"D4":true,"Z9":5,"note":"n"}'])
    assert {k: float(got[k]) for k in ("A1", "B2", "C3", "D4")} == {"A1": 2, "B2": 1, "C3": 0, "D4": 1}
    assert len(got) == 18 and got["Z9"] == "5" and got["note"] == "n"


def test_patched_grid_verifies(spark):
    patched = J.patch_grid(J.as_map(F.col("v")))
    assert all(evaluated(spark, J.verify_grid(patched), ['{"A1":3}', "{}", '{"A1":"NaN"}', None]))


def test_a_number_is_no_reason(spark):
    texts = ['[{"center":[0.5,0.5],"weight":1,"reasoning":7}]', '[{"center":[0.5,0.5],"weight":1,"reasoning":"7"}]', '[{"center":[0.5,0.5],"weight":1,"reasoning":null}]']
    assert evaluated(spark, J.verify_points(J.points(F.col("v"))), texts) == [False, True, False]
    assert [len(p) for p in evaluated(spark, J.patch_points(J.points(F.col("v"))), texts)] == [0, 1, 0]


def test_repair(spark):
    texts = [
        '{"result":{"A1":3}}', '{"result":[{"center":[2,0],"weight":1,"reasoning":"r"},5]}', '{"result":[5]}', '{"result":null,"no_weighting":true}', '{"result":null}',
        '{"result":"```json[]```"}', "[1]", "no", None, '{"result":"sorry"}', '{"no_weighting":true}',
    ]
    rows = J.repaired(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    assert [(r["format_verified"], r["content_verified"], r["no_weighting"]) for r in rows] == [
        (True, True, False), (True, True, False), (True, False, False), (True, True, True), (None, None, False), (True, False, False), (None, None, False), (None, None, False), (None, None, False),
        (None, None, False), (True, True, True),
    ]


def test_saved_responses(spark):
    assert [tuple(r) for r in evaluated(spark, J.saved_response(F.col("v"), 1), ['x {"A1": 1}', '{"A1": 3}', "none", "sorry"])] == [
        ('{"A1": 1}', True, True, False), ('{"A1": 3}', True, False, False), (None, True, True, True), ("sorry", False, False, False),
    ]
    with pytest.raises(ValueError, match="invalid grid"):
        J.saved_response(F.col("v"), -1)


def test_points(spark):
    texts = ['[{"center":[1.5,-1],"weight":9,"reasoning":" r "}]', "[]", '[{"center":[0.5],"weight":1,"reasoning":"r"}, 3]']
    assert evaluated(spark, J.verify_points(J.points(F.col("v"))), texts) == [False, False, False]
    got = evaluated(spark, J.patch_points(J.points(F.col("v"))), texts)
    assert [tuple(p["center"]) + (p["weight"], p["reasoning"]) for p in got[0]] == [(1.0, 0.0, 2.0, "r")]
    assert got[1] == [] and got[2] == []


def test_matches(spark):
    texts = ['{"matches":null}', '{"matches":[{"image_number":1,"confidence":"high"}]}', '{"matches":[{"image_number":1}]}', '{"top_100":[]}', "no"]
    assert evaluated(spark, J.verify_matches(F.col("v")), texts) == [True, True, False, False, False]


def test_markers(spark):
    texts = ["Compare {IMAGE_0} with {IMAGE_1-3}", "plain", "{IMAGE_2-IMAGE_11}"]
    got = evaluated(spark, prompts.expand_markers(F.col("v")), texts)
    assert got == ["Compare {IMAGE_0} with {IMAGE_1} {IMAGE_2} {IMAGE_3}", "plain", "{IMAGE_2-IMAGE_11}"]
    [parts] = evaluated(spark, prompts.message_parts(F.col("v"), F.lit(2)), ["a {IMAGE_1} {IMAGE_5} b"])
    assert [tuple(p) for p in parts] == [("text", "a"), ("image", "1"), ("text", "b")]


def test_missing_prompt_raises(spark):
    with pytest.raises(Exception, match="no such prompt"):
        evaluated(spark, prompts.filled(F.col("v"), {}), [None])


def test_replies_are_cleaned_and_parsed_once(spark, tmp_path):
    """Each step's value is made once, where the query had cleaned and parsed a reply again for each use."""
    odd = [None, "", " none\n", "[]", "{}", "[1,]", "x [{\"center\":[0.5,0.25],\"weight\":1,\"reasoning\":\"a\"}] y", "[{\"center\":\"no\",\"weight\":1,\"reasoning\":\"a\"}]", "{\"A1\":1} [", "```json\n{" + ",".join(f"\"{k}\":1" for k in J.grid_keys()) + ",}```", "[{\"center\":[0.5,2],\"weight\":1,\"reasoning\":\"a\"}", "7"]
    rows = spark.createDataFrame(list(enumerate(odd)), "i int, v string").repartition(2)
    for form in ("points", "grid"):
        once = J.process(rows, "v", form, "p").select("i", "p.*")
        assert {tuple(r) for r in once.collect()} == {tuple(r) for r in rows.select("i", J.processed(F.col("v"), form).alias("p")).select("i", "p.*").collect()}
    spark.range(30).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    plan = reference.process_replies(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("regexp_replace("), plan.count("regexp_extract(")) == (6, 4)
