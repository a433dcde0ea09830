"""A ledger kept as numbered immutable generations, each with a manifest that says what belongs to it.

A generation is a folder of Parquet files. Once all of them are there, its manifest is written beside them under another
name and renamed, which is what publishes it: a generation without a manifest does not exist. The manifest lists each
file's bytes, rows and a checksum of its rows (an order-free sum of their hashes, added up on the cluster). Loading goes
from the newest manifest down: the files' names and bytes are compared first, then all rows are read and summed; a
generation with a file missing, added, cut short or changed is passed over for the one before it. If there are manifests
but none holds, loading fails rather than start afresh; without any manifest the ledger is empty.

Generations are numbered by who publishes: a second writer of the same number fails to rename and takes the next one.
"""

from __future__ import annotations

import json
import uuid
from typing import Any, NamedTuple

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class DamagedError(RuntimeError):
    """There are generations, but none of them is whole."""


class Generation(NamedTuple):
    number: int
    folder: str
    files: dict[str, dict[str, int]]
    more: dict[str, Any]
    schema: StructType


def _fs(spark: SparkSession, path: str) -> tuple[Any, Any]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def listed(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes of the files of a folder by name; none if there is no such folder."""
    fs, at = _fs(spark, path)
    return {s.getPath().getName(): s.getLen() for s in fs.listStatus(at)} if fs.exists(at) else {}


def read_text(spark: SparkSession, path: str) -> str:
    fs, at = _fs(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def published(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file under another name and rename it; False if ``path`` is there already."""
    fs, at = _fs(spark, path)
    if fs.exists(at):
        return False
    _, draft = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(draft, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    if fs.exists(at) or not fs.rename(draft, at):
        fs.delete(draft, False)
        return False
    return True


def sums(rows: DataFrame) -> dict[str, tuple[int, int]]:
    """Rows and checksum by file; one row a file."""
    file = F.element_at(F.split(F.input_file_name(), "/"), -1)
    hashed = F.xxhash64(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).cast("decimal(38,0)")
    return {r["file"]: (r["n"], int(r["h"])) for r in rows.select(file.alias("file"), hashed.alias("h")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("h").alias("h")).collect()}


def manifests(spark: SparkSession, base: str) -> list[int]:
    """Numbers of the published generations, newest first."""
    names = listed(spark, f"{base}/manifests")
    return sorted((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), reverse=True)


def read_manifest(spark: SparkSession, base: str, number: int) -> Generation:
    m = json.loads(read_text(spark, f"{base}/manifests/{number:09d}.json"))
    return Generation(number, f"{base}/{m['folder']}", m["files"], m["more"], StructType.fromJson(m["schema"]))


def saved(rows: DataFrame, base: str, **more: Any) -> Generation:
    """Write ``rows`` as the next generation; ``more`` is kept in its manifest."""
    spark, folder = rows.sparkSession, f"data-{uuid.uuid4().hex}"
    rows.write.mode("errorifexists").parquet(f"{base}/{folder}")
    sizes = {n: s for n, s in listed(spark, f"{base}/{folder}").items() if n.startswith("part-")}
    found = sums(spark.read.schema(rows.schema).parquet(f"{base}/{folder}")) if sizes else {}
    files = {n: {"bytes": s, "rows": found.get(n, (0, 0))[0], "sum": found.get(n, (0, 0))[1]} for n, s in sizes.items()}
    text = json.dumps({"folder": folder, "files": files, "more": more, "schema": json.loads(rows.schema.json())})
    number = next(iter(manifests(spark, base)), -1) + 1
    while not published(spark, f"{base}/manifests/{number:09d}.json", text):
        number += 1
    return Generation(number, f"{base}/{folder}", files, more, rows.schema)


def whole(spark: SparkSession, g: Generation) -> bool:
    """Whether the generation's files are all there, of their sizes, and hold the rows that were written."""
    there = {n: s for n, s in listed(spark, g.folder).items() if n.startswith("part-")}
    if there != {n: f["bytes"] for n, f in g.files.items()}:
        return False
    if not g.files:
        return True
    try:
        found = sums(spark.read.schema(g.schema).parquet(g.folder))
    except (PySparkException, Py4JJavaError):  # not readable as Parquet any more
        return False
    return found == {n: (f["rows"], f["sum"]) for n, f in g.files.items() if f["rows"]}


def newest(spark: SparkSession, base: str) -> Generation | None:
    """The newest whole generation; None if none was ever published."""
    numbers = manifests(spark, base)
    for number in numbers:
        try:
            g = read_manifest(spark, base, number)
        except (ValueError, KeyError):  # a manifest that is cut short
            continue
        if whole(spark, g):
            return g
    if numbers:
        raise DamagedError(f"none of the {len(numbers)} generations of {base} is whole")
    return None


def loaded(spark: SparkSession, base: str, schema: str | StructType) -> DataFrame:
    """The rows of the newest whole generation; an empty table of ``schema`` if there is none at all."""
    g = newest(spark, base)
    return spark.read.schema(g.schema).parquet(g.folder) if g and g.files else spark.createDataFrame([], schema)


def pruned(spark: SparkSession, base: str, keep: int = 2) -> list[int]:
    """Delete all but the newest ``keep`` whole generations and what is older; the numbers that went."""
    gone, good = [], 0
    for number in manifests(spark, base):
        if good >= keep:
            g = read_manifest(spark, base, number)
            for path in (f"{base}/manifests/{number:09d}.json", g.folder):  # the manifest first: what is not published is not read
                fs, at = _fs(spark, path)
                fs.delete(at, True)
            gone.append(number)
        else:
            good += whole(spark, read_manifest(spark, base, number))
    return gone
