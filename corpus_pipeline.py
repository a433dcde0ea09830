"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept.

Quality rules and the quality classifier drop documents, near-dedup (five-word shingles, Jaccard similarity
0.8 or more) leaves the least id of each group, the byte-level dedup cuts repeated strings out of the texts (characters
stay whole), and packing lays out token sequences.

Nulls and edges: a null or empty text fails the rules; a null lang, source or n_chars is kept as it is; documents without
an id are judged, and near-dedup neither drops them nor lets them drop others; of repeated rows one stays; further
columns of the table, whatever their names, are dropped at the first stage; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placegrid.llm import byte_suffixes, packing, quality_classifier, quality_rules, similar
from placegrid.llm.common import discard, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.kept_documents(docs.select(*COLUMNS), labels(spark, sf_dir))


def classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.kept_documents(docs.select(*COLUMNS), labels(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return similar.one_of_each(docs.select(*COLUMNS))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = byte_suffixes.remove_repeats(docs, carry=("lang", "source"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules_stage),
    ("quality_classifier", classifier_stage),
    ("simhash_near_dedup", near_dedup_stage),
    ("suffix_array_dedup", repeats_stage),
    ("best_fit_packing", packing_stage),
]

#: The classifier, the fingerprints and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, written(stage(spark, docs, sf_dir))
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
