"""Hashed word features and bounded labelled samples, for the models that are trained here."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegrid.llm.common import discard, mix, written

#: Words remembered by a Python worker before it starts afresh.
CACHE = 100_000


def subwords(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of whole words and of their 3- to 5-byte n-grams (word ends marked), and the words' indices; unordered."""
    text = np.frombuffer(b"".join([b"<%b>" % w for w in words]), np.uint8).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    of = np.repeat(np.arange(len(words)), size)
    ids, index = [np.fromiter(map(zlib.crc32, words), np.uint64, len(words))], [np.arange(len(words))]
    gram = text
    for k in (2, 3, 4, 5):
        gram = gram[:-1] * np.uint64(0x100000001B3) + text[k - 1 :]
        if k > 2:
            own = of[: len(gram)] == of[k - 1 :]
            ids.append(mix(gram[own]))
            index.append(of[: len(gram)][own])
    return (np.concatenate(ids) % np.uint64(buckets)).astype(np.int32), np.concatenate(index)


def stems(word: bytes, buckets: int) -> list[int]:
    """Buckets of the lower-cased word without outer punctuation, and of its starts of 4 to 6 bytes."""
    w = word.lower().strip(b".,;:!?\"'()[]*#$%&")
    crc = zlib.crc32
    return [crc(w) % buckets, *(crc(b"^" + w[:k]) % buckets for k in (4, 5, 6) if len(w) > k)] if w else []


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, size: int) -> pd.DataFrame:
    """(text, label) of at most ``rows`` labelled documents and ``size`` bytes of text, in an order by hash.

    The bound holds what the driver trains on, whatever the corpus; nulls are left out, of several labels of a document
    the least counts, and of several texts the shortest. Only labels of documents that are there take places, and a text
    that does not fit into what is left of ``size`` is passed over for those after it. Rows are reduced to one a
    document on the cluster. If the first ``rows`` labelled documents fit, which is the rule, texts are read once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    there = written(known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("rank", F.xxhash64("doc_id", F.lit(7))))
    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text")).where("text is not null")

    def fetched(few: DataFrame) -> DataFrame:
        """The texts of at most ``rows`` documents."""
        least = F.min(F.struct(F.octet_length("text").alias("bytes"), "text"))
        return written(texts.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label", "rank").agg(least.alias("t")).select("doc_id", "label", "rank", "t.*"))

    def taken(sizes: pd.DataFrame, left: int) -> tuple[list[tuple[int, int, int]], int]:
        ids = []
        for r in sizes.itertuples(index=False):
            if r.bytes <= left:
                left -= r.bytes
                ids.append((int(r.doc_id), int(r.label), int(r.rank)))
        return ids, left

    first = fetched(there.orderBy("rank", "doc_id").limit(rows))
    ids, left = taken(first.select("doc_id", "label", "rank", "bytes").toPandas().sort_values(["rank", "doc_id"]), size)
    if len(ids) < rows and there.count() > rows:  # some did not fit or have no text: sizes of all decide
        sizes = texts.groupBy("doc_id").agg(F.min(F.octet_length("text")).alias("bytes"))
        sized = written(there.join(sizes, "doc_id"))
        ids, left, more = [], size, sized.where(F.col("bytes") <= size)
        while rows > len(ids):
            asked = rows - len(ids)
            some = more.orderBy("rank", "doc_id").limit(asked).toPandas()
            got, left = taken(some, left)
            ids += got
            if len(some) < asked:
                break
            last = some.iloc[-1]
            after = F.struct("rank", "doc_id") > F.struct(F.lit(int(last["rank"])).alias("rank"), F.lit(int(last["doc_id"])).alias("doc_id"))
            more = sized.where(after & (F.col("bytes") <= int(left)))
        discard(first, sized)
        first = fetched(docs.sparkSession.createDataFrame(pd.DataFrame(ids, columns=["doc_id", "label", "rank"]), "doc_id long, label int, rank long"))
    chosen = {i for i, _, _ in ids}
    got = first.where(F.col("bytes") <= size).toPandas().sort_values(["rank", "doc_id"])
    discard(first, there)
    return got[got["doc_id"].isin(chosen)][["doc_id", "text", "label"]].reset_index(drop=True)
