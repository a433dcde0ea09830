"""Missing and corrupt shards, which the registered query's rows hold only in part."""

from __future__ import annotations

from placegrid.operators import ledger


def test_missing_and_corrupt_shards(spark):
    expected = spark.range(6).withColumnRenamed("id", "shard")
    found = spark.createDataFrame([(0, 5), (1, 0), (2, 9), (4, 0)], "shard long, rows long")
    assert tuple(ledger.shard_completeness(expected, found).first()) == (6, 2, 2, 2, 2 / 6)


def test_query_counts_every_event(spark, tmp_path):
    from placegrid.plans import reference

    ids = spark.createDataFrame([(i,) for i in (1, 21, 14, 49)], "event_id long")  # 21 is a multiple of 7, 14 is not counted, shard 4 is left out
    ids.write.parquet(str(tmp_path / "events.parquet"))
    out = reference.queries()["shard_completeness"](spark, str(tmp_path)).first()
    assert (out["expected"], out["found"], out["missing"], out["corrupt"]) == (4, 2, 1, 1)
