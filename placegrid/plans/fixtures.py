"""Inputs of the registered queries, built from the driver's tables by expressions that Spark and DuckDB share.

Every text here is SQL that both engines read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAT = "CAST(37.70 AS DOUBLE) + CAST({k} * 7919 % 10000 AS DOUBLE) / CAST(100000 AS DOUBLE)"
LON = "CAST(-122.50 AS DOUBLE) + CAST({k} * 104729 % 10000 AS DOUBLE) / CAST(100000 AS DOUBLE)"
LAT_TEXT = "'37.' || CAST(70000 + {k} * 7919 % 10000 AS VARCHAR(9))"
LON_TEXT = "'-122.' || CAST(50000 - {k} * 104729 % 10000 AS VARCHAR(9))"
EAST, NORTH = "'0' || CAST(543000 + {k} % 997 AS VARCHAR(9)) || '.40'", "CAST(4179000 + {k} % 991 AS VARCHAR(9)) || '.38'"

DASH = (
    f"CASE {{k}} % 11 WHEN 0 THEN 'bad_name.jpg' WHEN 1 THEN '91.0_10.0@x.jpg' WHEN 2 THEN {LAT_TEXT} || '_' || {LON_TEXT} "
    f"ELSE 'n' || CAST({{k}} AS VARCHAR(9)) || '%' || {LAT_TEXT} || '_' || {LON_TEXT} || '@NA@NA@NA@' || {EAST} || '@' || {NORTH} || '.jpg' END"
)
AT = (
    f"CASE {{k}} % 7 WHEN 0 THEN {EAST} || '@' || {NORTH} || '@10@S@0' || {LAT_TEXT} || '@' || {LON_TEXT} || '.json' "
    f"WHEN 1 THEN '@1@2@10@S@37.7@-122.5.jpg' WHEN 2 THEN 'nothing.png' "
    f"ELSE '@' || {EAST} || '@' || {NORTH} || '@10@S@0' || {LAT_TEXT} || '@' || {LON_TEXT} || '@h' || CAST({{k}} AS VARCHAR(9)) || '@@.jpg' END"
)

_CELLS = [(f"{chr(65 + r)}{c + 1}", r, c) for r in range(4) for c in range(4)]
_CELL = "'\"{name}\":' || CASE WHEN event_id % 13 = {n} THEN '\"high\"' ELSE CAST((event_id * {m} + {c}) % 25 AS VARCHAR(9)) END || '{end}'"
#: Grids with weights 0 to 24, some texts, one cell missing where event_id % 5 = 0, and a further key where event_id % 7 = 0.
GRID = "'{' || " + " || ".join(
    ("CASE WHEN event_id % 5 = 0 THEN '' ELSE " if i == 0 else "") + _CELL.format(name=n, n=4 * r + c, m=r + 1, c=c, end="," if i < 15 else "") + (" END" if i == 0 else "") for i, (n, r, c) in enumerate(_CELLS)
) + " || CASE WHEN event_id % 7 = 0 THEN ',\"note\":\"x' || CAST(event_id AS VARCHAR(9)) || '\"' ELSE '' END || '}'"
#: Two points: a blank or numeric reason, a weight that is a text, a center of one number, and no point at all occur.
POINTS = (
    "CASE WHEN event_id % 10 = 7 THEN '[]' ELSE '[{\"center\":[0.' || CAST(event_id % 9 AS VARCHAR(9)) || ',' || CAST(event_id % 3 AS VARCHAR(9)) || '],\"weight\":' || "
    "CASE WHEN event_id % 9 = 4 THEN '\"heavy\"' ELSE CAST(event_id % 5 AS VARCHAR(9)) END || ',\"reasoning\":\"' || "
    "CASE WHEN event_id % 4 = 0 THEN '' ELSE 'door' END || '\"},{\"center\":[' || CASE WHEN event_id % 6 = 0 THEN '0.5' ELSE '0.5,0.25' END || '],\"weight\":1,\"reasoning\":' || "
    "CASE WHEN event_id % 8 = 1 THEN '7' ELSE '\"sign\"' END || '}]' END"
)
REPLY = (
    f"CASE event_id % 6 WHEN 0 THEN '```json' || chr(10) || {POINTS} || chr(10) || '```' WHEN 1 THEN 'Here it is: ' || {POINTS} WHEN 2 THEN ' None ' "
    f"WHEN 3 THEN replace({POINTS}, '}}]', '}},]') WHEN 4 THEN 'sorry' ELSE {POINTS} END"
)
MATCHES = (
    "CASE event_id % 6 WHEN 0 THEN '{\"matches\":[{\"image_number\":' || CAST(event_id AS VARCHAR(9)) || ',\"confidence\":\"high\",\"reasoning\":\"x\"}]}' WHEN 1 THEN '{\"matches\":null}' "
    "WHEN 2 THEN '{\"matches\":[{\"image_number\":1}]}' WHEN 3 THEN '{\"top_100\":[]}' "
    "WHEN 4 THEN '```json{\"top_100\":[1],\"matches\":[{\"image_number\":2,\"confidence\":\"low\"},]}```' ELSE 'no match ' || CAST(event_id AS VARCHAR(9)) END"
)
_TEXT = f"replace(replace({REPLY}, '\"', chr(92) || '\"'), chr(10), chr(92) || 'n')"
#: Annotation documents: points, a grid, no weighting, no result, a text, broken, a number, and a grid without wrapper.
DOCUMENT = (
    f"CASE event_id % 8 WHEN 0 THEN '{{\"result\":' || {POINTS} || '}}' WHEN 1 THEN '{{\"timestamp\":\"t\",\"result\":' || {GRID} || '}}' "
    f"WHEN 2 THEN '{{\"result\":null,\"no_weighting\":true}}' WHEN 3 THEN '{{\"result\":null}}' WHEN 4 THEN '{{\"result\":\"' || {_TEXT} || '\"}}' "
    f"WHEN 5 THEN '{{\"result\":' WHEN 6 THEN '{{\"result\":7}}' ELSE {GRID} END"
)
MARKERS = "'Compare {IMAGE_0} with {IMAGE_' || CAST(turn AS VARCHAR(9)) || '-' || CAST(turn + conv_id % 4 AS VARCHAR(9)) || '} and ' || role"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_sql(text: str) -> str:
    """The shared expression as Spark reads it."""
    return text.replace("AS VARCHAR(9)", "AS STRING")


def spread(rows: DataFrame) -> DataFrame:
    """Small single-file tables dealt over the cores; tables with enough partitions stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def built(spark: SparkSession, sf_dir: str, source: str, key: str, **columns: str) -> DataFrame:
    """``key`` of a table and columns from shared expressions ({k} stands for the key)."""
    rows = spread(table(spark, sf_dir, source).select(key))
    return rows.select(key, *[F.expr(spark_sql(e.replace("{k}", key))).alias(n) for n, e in columns.items()])


def vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries: query, features, label) with vec_id % 10 = 0 and (references: target, features, label)."""
    rows = table(spark, sf_dir, "embeddings")
    own = rows.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("features"), "label")
    return own, rows.where("vec_id % 10 <> 0").select(F.col("vec_id").alias("target"), F.col("embedding").alias("features"), "label")


def places(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(queries from suppliers, targets from customers) with coordinates."""
    q = built(spark, sf_dir, "supplier", "s_suppkey", lat=LAT, lon=LON).withColumnRenamed("s_suppkey", "query")
    return q, built(spark, sf_dir, "customer", "c_custkey", lat=LAT, lon=LON).withColumnRenamed("c_custkey", "target")
