"""Image folders, path lists, annotation documents and the result sinks."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

from placegrid.functions.jsonclean import kind
from placegrid.functions.paths import ANNOTATION, basename, has_suffix, stem
from placegrid.sources.files import registered


def scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ANNOTATION, any_case: bool = True, content: bool = False) -> DataFrame:
    """path, basename (and content) of a folder's files by suffix; not recursive; order it where order matters."""
    files = spark.read.format("binaryFile").load(f"{folder}/*")
    found = files.withColumn("basename", basename(F.col("path"))).where(has_suffix(F.col("basename"), suffixes, any_case))
    return found.select("path", "basename", *(["content"] if content else []))


def path_list(spark: SparkSession, file: str, root: str, suffixes: tuple[str, ...] = ANNOTATION) -> DataFrame:
    """path, basename from a text file of relative paths: trimmed, blanks skipped, other suffixes dropped."""
    lines = spark.read.text(file).select(F.trim("value").alias("p")).where((F.col("p") != "") & has_suffix(F.col("p"), suffixes))
    return lines.select(F.concat(F.lit(root.rstrip("/") + "/"), "p").alias("path"), basename(F.col("p")).alias("basename"))


def images(spark: SparkSession, folder: str, listing: str | None = None, suffixes: tuple[str, ...] = ANNOTATION) -> DataFrame:
    """The path list if it can be read and names anything, else the folder's files."""
    if listing:
        try:
            listed = path_list(spark, listing, folder, suffixes)
            if not listed.isEmpty():
                return listed
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return scan(spark, folder, suffixes)


def annotations(spark: SparkSession, folder: str) -> DataFrame:
    """filename, text, kind of a folder's JSON files; bytes that are no UTF-8 are read as Latin-1; kind NULL: not JSON."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.json")
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select(basename(F.col("path")).alias("filename"), text.alias("text")).withColumn("kind", kind(F.col("text")))


def retrieval_json(retrieval: DataFrame) -> DataFrame:
    """query, json: {"target_path": [...], "similarity_score": [...]} in rank order, scores to ten digits."""
    rows = retrieval.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "target", "score"))).alias("r"))
    body = F.struct(F.transform("r", lambda x: x["target"]).alias("target_path"), F.transform("r", lambda x: F.round(x["score"], 10)).alias("similarity_score"))
    return rows.select("query", F.to_json(body).alias("json"))


def read_retrieval(spark: SparkSession, path: str) -> DataFrame:
    """query, rank, target, score from rows of (query, json) written as Parquet."""
    body = F.from_json("json", "target_path array<string>, similarity_score array<double>")
    rows = spark.read.parquet(path).select("query", body.alias("b"))
    return rows.select("query", F.posexplode(F.arrays_zip("b.target_path", "b.similarity_score")).alias("rank", "t")).select("query", (F.col("rank") + 1).alias("rank"), F.col("t.target_path").alias("target"), F.col("t.similarity_score").alias("score"))


def write_csv(rows: DataFrame, path: str) -> None:
    """A result table as CSV with a header, atomically through the output committer."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def generated_name(base: Column, index: Column) -> Column:
    return F.concat(base, F.lit("_generated_"), index.cast("string"), F.lit(".png"))


def sorted_scan(spark: SparkSession, folder: str, suffixes: tuple[str, ...] = ANNOTATION, any_case: bool = True) -> DataFrame:
    """path, basename in the order of paths."""
    return scan(spark, folder, suffixes, any_case).orderBy("path")


def put_files(rows: DataFrame, folder: str) -> DataFrame:
    """Write rows (name, content: binary) as one file each into a folder of any URI; name, bytes of what was written.

    All or nothing (see ``files``): a failed task or job leaves no file. Names must be distinct; a file of the same name is
    replaced.
    """
    spark = registered(rows.sparkSession)
    there = rows.where("content is not null").select("name", "content")
    there.write.format("smallfiles").mode("append").option("path", folder).save()
    found = spark.read.format("smallfiles").option("path", folder).load().select(F.col("basename").alias("name"), "bytes")
    return found.join(there.select("name"), "name", "left_semi")


def annotation_files(rows: DataFrame) -> DataFrame:
    """name, content of annotation documents: <stem>.json, two spaces of indentation, non-ASCII kept.

    ``rows``: image_path, model, format_verified, content_verified, no_weighting, result (JSON, or a text that is none).
    """

    @F.pandas_udf("string")
    def pretty(path: pd.Series, model: pd.Series, right: pd.Series, content: pd.Series, none: pd.Series, result: pd.Series) -> pd.Series:
        def one(p, m, r, c, n, x):
            try:
                value = None if x is None else json.loads(x)
            except ValueError:
                value = x
            whole = {"image_path": p, "model": m, "json_format_verified": bool(r), "json_content_verified": bool(c), "no_weighting": bool(n), "result": value}
            return json.dumps(whole, indent=2, ensure_ascii=False)

        return pd.Series([one(*x) for x in zip(path, model, right, content, none, result, strict=True)])

    text = pretty("image_path", "model", "format_verified", "content_verified", "no_weighting", "result")
    return rows.select(F.concat(stem(basename(F.col("image_path"))), F.lit(".json")).alias("name"), text.cast("binary").alias("content"))


def individual_csv(results: DataFrame, path: str) -> None:
    """The per-query results (of ``individual_results``) under the names of their CSV."""
    names = {"query": "query_path", "num_predicted": "num_predicted_paths", "num_gt": "num_gt_paths", "predicted": "predicted_paths", "gt": "gt_paths"}
    write_csv(results.withColumnsRenamed(names), path)


def timing_csv(rows: DataFrame, path: str) -> None:
    """filename, processing_time (seconds, three decimals)."""
    write_csv(rows.select("filename", F.round("processing_time", 3).alias("processing_time")), path)


def usage_lines(usage: DataFrame) -> DataFrame:
    """line: "key: value" of a one-row usage table, in the order of its columns."""
    cells = F.array(*[F.concat(F.lit(f"{c}: "), F.col(c).cast("string")) for c in usage.columns])
    return usage.select(F.explode(cells).alias("line"))


def usage_text(usage: DataFrame, folder: str, stamp: str) -> None:
    """The usage lines as text under a folder named by a time stamp."""
    usage_lines(usage).coalesce(1).write.mode("errorifexists").text(f"{folder.rstrip('/')}/usage_{stamp}")


def feature_table(shards: DataFrame, path: str, rows_per_file: int = 1_000_000) -> None:
    """Feature rows (path, features) of all shards as one Parquet dataset; files are bounded, nothing is concatenated."""
    shards.select("path", "features").write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(path)


def serialised(rows: DataFrame, column: str) -> Column:
    """A column of any type as JSON text, arrays in full."""
    kind_ = rows.schema[column].dataType
    return F.to_json(column) if isinstance(kind_, (ArrayType, MapType, StructType)) else F.col(column).cast("string")
