"""Languages are strata of their own, whatever their hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid.llm import quality_rules
from tests.llm.test_quality_rules import table


def test_languages_of_one_bucket_do_not_share_cutoffs(spark):
    names = spark.range(300).select(F.concat(F.lit("l"), "id").alias("lang")).withColumn("b", F.pmod(F.xxhash64("lang"), F.lit(64)))
    pairs = names.groupBy("b").agg(F.sort_array(F.collect_list("lang")).alias("l")).where("size(l) > 1").orderBy("b").first()["l"]
    for big, small in ((pairs[0], pairs[1]), (None, "")):
        docs, labels = table(spark, [(big, 60000 // 15, 0, 1), (big, 400, 40, 0), (small, 30, 40, 1), (small, 700, 0, 1)])
        out = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").toPandas()
        mine = out["lang"].isna() if big is None else out["lang"] == big
        assert not out[mine & (out["quality"] == 0)]["kept"].any()
        assert out[~mine]["kept"].all()  # 4 % of its good documents have symbols
