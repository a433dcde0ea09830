"""Document fingerprints by consistent weighted sampling.

A text is a weighted set of terms (its words, weighted by their occurrences). For each
of ``SAMPLES`` samples every term draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) from its hash; with t = floor(ln w / r + b)
and ln a = ln c - r (t - b) - r the term of least a is taken, and (term, t) is the sample. Two texts agree in a sample
with a probability equal to their generalised Jaccard similarity, sum of minima over sum of maxima. A fingerprint keeps
16 bits of each sample.

Draws depend on (term, weight) alone, so a batch draws once for each distinct pair.

Nulls and edges: a null text counts as empty; texts without words share one fingerprint and are alike (1.0) among
themselves, unlike (about 0) any other; repeated rows give equal fingerprints; extra columns are ignored; an empty
table gives no rows. Rows of equal doc_id follow each other in the order of their texts, null ids come first.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from placegrid.llm.common import mix, partitions, texts, tune

SAMPLES = 64
#: Ranges of ids at most; they are streamed in order, so their size does not matter for memory.
PARTS = 1 << 16
#: Terms whose draws are made at once.
BLOCK = 4096


def uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(40)).astype(np.float32) + np.float32(0.5)) * np.float32(2.0**-24)


def draws(term: np.ndarray, weight: np.ndarray, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """ln a (float32) and the sample's 16 bits for each term (rows) and sample (columns)."""
    with np.errstate(over="ignore"):
        seeds = mix(np.arange(1, samples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        h = mix(term[:, None] ^ seeds[None, :])
        u = []
        for _ in range(5):
            h = h * np.uint64(0x5851F42D4C957F2D) + np.uint64(0x14057B7EF767814F)
            u.append(uniform(h ^ (h >> np.uint64(29))))
        r, c, b = -np.log(u[0] * u[1]), -np.log(u[2] * u[3]), u[4]
        t = np.floor(np.log(weight.astype(np.float32))[:, None] / r + b)
        a = np.log(c) - r * (t - b) - r
        mark = mix(term[:, None] + t.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return a, (mark >> np.uint64(48)).astype(np.uint16)


def term_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of a text as 64-bit hashes, and their counts."""
    found = Counter(text.split())
    return np.fromiter(map(xxh64_intdigest, found), np.uint64, len(found)), np.fromiter(found.values(), np.int64, len(found))


def signatures(found: list[tuple[np.ndarray, np.ndarray]], samples: int = SAMPLES) -> np.ndarray:
    """One row of 16-bit samples for each weighted set."""
    out = np.zeros((len(found), samples), np.uint16)
    if not (full := [i for i, (t, _) in enumerate(found) if len(t)]):
        return out
    term, weight = (np.concatenate([found[i][j] for i in full]) for j in (0, 1))
    _, first, at = np.unique(mix(term) ^ (weight.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), return_index=True, return_inverse=True)
    a, mark = np.empty((len(first), samples), np.float32), np.empty((len(first), samples), np.uint16)
    for i in range(0, len(first), BLOCK):
        a[i : i + BLOCK], mark[i : i + BLOCK] = draws(term[first[i : i + BLOCK]], weight[first[i : i + BLOCK]], samples)
    stop = np.cumsum([len(found[i][0]) for i in full])
    for i, lo, hi in zip(full, np.r_[0, stop[:-1]], stop, strict=True):
        own = at[lo:hi]
        out[i] = mark[own[a[own].argmin(axis=0)], np.arange(samples)]
    return out


def placed(cuts: np.ndarray, heads: list[tuple[int, int | None]]) -> Callable[[Column], Column]:
    """struct(part, before): an id's range, and the range before it if the id is its range's first one.

    ``heads``: (part, first id) of the ranges that have rows, in order.
    """
    parts = np.array([p for p, _ in heads], np.int64)
    firsts = np.array([0 if i is None else i for _, i in heads], np.int64)
    null = bool(heads) and heads[0][1] is None

    @F.pandas_udf("part int, before int")
    def place(ids: pd.Series) -> pd.DataFrame:
        known = ids.notna().to_numpy()
        value = ids.fillna(0).to_numpy(np.int64)
        part = np.where(known, np.searchsorted(cuts, value), 0)
        at = np.minimum(np.searchsorted(parts, part), max(len(parts) - 1, 0))
        first = (np.where(known, firsts[at] == value, False) & ~(null & (at == 0)) | (~known & null)) if len(parts) else np.zeros(len(value), bool)
        before = pd.array(parts[at - 1] if len(parts) else value, dtype="Int32")
        before[~first] = pd.NA
        return pd.DataFrame({"part": part.astype(np.int32), "before": before})

    return place


def following(docs: DataFrame, parts: int) -> DataFrame:
    """doc_id, text, next text in the order of doc_id (after the last: the first), without a global sort in one task.

    Ids are cut into ``parts`` ranges at approximate quantiles; the first row of each range is also sent to the range
    before it (the very first to the last), so neighbours meet in one task. Ranges are streamed in order.
    """
    rows = texts(docs).withColumn("text", F.coalesce("text", F.lit(b"")))
    cuts = docs.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], max(10000, 4 * parts)).alias("c")).first()["c"] if parts > 1 else []
    cuts = np.array(sorted(set(cuts or [])), np.int64)  # at most ``parts`` numbers
    part = placed(cuts, [])(F.col("doc_id"))["part"]
    heads = docs.select("doc_id", part.alias("part")).groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("head")).orderBy("part").collect()
    both = rows.withColumn("to", placed(cuts, [(r["part"], r["head"]["doc_id"]) for r in heads])(F.col("doc_id")))
    sent = F.array_compact(F.array(F.struct(F.col("to.part").alias("part"), F.lit(False).alias("guest")), F.when(F.col("to.before").isNotNull(), F.struct(F.col("to.before").alias("part"), F.lit(True).alias("guest")))))
    both = both.select("doc_id", "text", F.explode(sent).alias("to")).select("doc_id", "text", "to.part", "to.guest")
    ordered = both.repartition(max(len(heads), 1), "part").sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_first(), "text")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict | None = None
        for b in batches:
            ids, nexts = [], ([], [])
            for row in b.to_pylist():
                if last and last["part"] == row["part"] and not last["guest"]:
                    ids.append(last["doc_id"])
                    nexts[0].append(last["text"])
                    nexts[1].append(row["text"])
                if not (last and row["guest"] and last["guest"] and last["part"] == row["part"]):
                    last = row
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(nexts[0], pa.binary()), pa.array(nexts[1], pa.binary())], names=["doc_id", "text", "next"])

    return ordered.mapInArrow(pair, "doc_id long, text binary, next binary")


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited_text(text: str, after: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first ones (or all it has)."""
    n = len(text) // 4
    return text[: len(text) - n] + after[:n]


def document_fingerprints(docs: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document."""
    tune(docs.sparkSession)
    rows = following(docs, min(partitions(docs, 8 << 20), PARTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 100):
                b = whole.slice(at, 100)
                ids, text, after = (b.column(i).to_pylist() for i in range(3))
                own = [t.decode("utf-8", "replace") for t in text]
                edit = [edited_text(t, n.decode("utf-8", "replace")) for t, n in zip(own, after, strict=True)]
                data = [e.encode() for e in edit]
                sets = [term_hashes(t) for t in text] + [term_hashes(d) for d in data]
                sets += [sets[i + 1] if i + 1 < len(text) and text[i + 1] == n else term_hashes(n) for i, n in enumerate(after)]
                k, sig = len(text), signatures(sets, samples)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids, pa.int64()), pa.array(map(len, own), pa.int64()), pa.array([hashlib.sha256(d).hexdigest() for d in data]),
                        pa.array([s.astype(">u2").tobytes().hex() for s in sig[:k]]), pa.array([s.astype(">u2").tobytes().hex() for s in sig[k : 2 * k]]),
                        pa.array([likeness(sig[i], sig[k + i]) for i in range(k)]), pa.array([likeness(sig[i], sig[2 * k + i]) for i in range(k)]),
                    ],
                    names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
                )

    return rows.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
