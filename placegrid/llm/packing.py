"""Best-fit packing by exact-complement hashing over length counts.

Tokenised documents are cut into pieces of at most ``size`` tokens. A packing depends on the pieces only through the
number of pieces of each length, at most ``size`` counts, so the plan is made from that histogram on the driver:
lengths go from long to short; the gap that a piece leaves is looked up in an index of single, pair and triple length
sums and combinations that fill it exactly are consumed as long as all their members are available; what has no exact
complement is filled by best fit (the largest sum of one or two available lengths that fits, again and again). The plan
is a list of (runs of equal lengths, copies). Pieces are then numbered within their length in a distributed way and looked up in the plan, so any
number of equal lengths spreads over all tasks.

Tokenising: the given tokenizer lower-cases and never joins text across white space (which its splitter drops), nor a
letter and a stop after it, so each distinct unit is encoded once by a worker and remembered; the ids of a document are
the concatenation, closed by id 0. Texts that hold the start of a special token (``<|``) are not lower-cased first.

Nulls and edges: a null or empty text is the single id 0; a null doc_id is packed like any other; repeated rows are
packed each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from placegrid.llm.common import mapped, texts, trim, tune, written

SIZE = 2048
CACHE = 400_000
#: Full stops and commas between a letter and the end of a unit: always a token boundary of their own.
STOP = re.compile(rb"(?<=[a-z])([.,]+)(?=\s|$)")


Runs = tuple[tuple[int, int], ...]


def planned(counts: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, copies) for counts[length] pieces of each length up to ``size``."""
    return [(tuple(p for p, times in runs for _ in range(times)), copies) for runs, copies in planned_runs(counts, size)]


def planned_runs(counts: np.ndarray, size: int) -> list[tuple[Runs, int]]:
    """(a sequence as runs of (length, times), copies) for counts[length] pieces of each length up to ``size``."""
    left = [0, *counts[1:].tolist()]
    pair_at, triple_at = [1] * (size + 1), [1] * (size + 1)  # by sum: the first member that may still serve; counts only fall, so it only moves on
    plan: list[tuple[Runs, int]] = []
    used: dict[int, int] = defaultdict(int)  # by the sequence that is being made

    def single(total: int) -> tuple[int, ...] | None:
        return (total,) if left[total] > used.get(total, 0) else None

    def pair(total: int) -> tuple[int, ...] | None:
        a = pair_at[total]
        while 2 * a <= total and not (left[a] and left[total - a]):
            a += 1
        pair_at[total] = a
        while 2 * a <= total:
            b = total - a
            if left[a] > used.get(a, 0) + (a == b) and left[b] > used.get(b, 0):
                return b, a
            a += 1
        return None

    def triple(total: int) -> tuple[int, ...] | None:
        a = triple_at[total]
        while 3 * a <= total and not left[a]:
            a += 1
        triple_at[total] = a
        while 3 * a <= total:
            if left[a] > used.get(a, 0):
                used[a] += 1
                two = pair(total - a)
                used[a] -= 1
                if two:
                    return *two, a
            a += 1
        return None

    def fitting(gap: int) -> tuple[int, ...] | None:
        """The largest sum of one or two available lengths that fits."""
        for total in range(gap, 0, -1):
            if parts := single(total) or pair(total):
                return parts
        return None

    for length in range(size, 0, -1):
        while left[length]:
            used.clear()
            used[length], runs, gap = 1, [(length, 1)], size - length
            parts = gap and (single(gap) or pair(gap) or triple(gap) or fitting(gap))
            while parts:
                # What was the largest to fit is so for the smaller gap too, as long as there is more of it.
                times = min(gap // sum(parts), *((left[p] - used.get(p, 0)) // parts.count(p) for p in parts))
                for p in parts:
                    used[p] += times
                    runs.append((p, times))
                gap -= times * sum(parts)
                parts = gap and fitting(gap)
            copies = min(left[p] // n for p, n in used.items() if n)
            plan.append((tuple(runs), copies))
            for p, n in used.items():
                left[p] -= n * copies
    return plan


def slots(plan: list[tuple[Runs, int]]) -> tuple[np.ndarray, ...]:
    """Sorted (length << 40 | first rank), first sequence, offset and copies of each run of slots of one length.

    Of a run's pieces the first ``copies`` lie at its offset in as many sequences, the next ones one length further on.
    """
    taken: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for runs, copies in plan:
        offset = 0
        for p, times in runs:
            rows.append((p << 40 | taken[p], sequence, offset, copies))
            taken[p] += copies * times
            offset += p * times
        sequence += copies
    rows.sort()
    return tuple(np.array(x, np.int64) for x in (zip(*rows, strict=True) if rows else ([], [], [], [])))


#: With these alone (besides letters beyond ASCII), every stop or comma before white space closes a unit.
PLAIN = bytes(c for c in range(128) if chr(c).isalnum() or chr(c) in " \n.,")


def units_of(text: bytes) -> list[bytes]:
    if b"<|" in text:
        return STOP.sub(rb" \1", text).split()
    text = text.lower()
    rest = text.translate(None, PLAIN)
    if (not rest or rest.decode("utf-8", "replace").isalpha()) and not any(x in text for x in (b"..", b".,", b",.", b",,")):
        text += b" "
        for mark in (b".", b","):
            text = text.replace(mark + b" ", b" " + mark + b" ").replace(mark + b"\n", b" " + mark + b"\n")
        return text.split()
    return STOP.sub(rb" \1", text).split()


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with a bounded memory of units."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # tokens that close a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def learn(self, units: list[bytes]) -> None:
        """Encode units: those of letters alone are one word each, so many are encoded as one text and cut at word ends."""
        words = [u.decode("utf-8", "replace") for u in units]
        plain = [i for i, w in enumerate(words) if w.isalpha()]
        other = [i for i, w in enumerate(words) if not w.isalpha()]
        for at in range(0, len(plain), 4000):
            some = plain[at : at + 4000]
            [got] = self.tokenizer.encode_batch_fast([" ".join([words[i] for i in some])], add_special_tokens=False)
            ids = np.array(got.ids, "<u4")
            stop = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(stop) != len(some):  # a letter whose lower case is not one
                other += some
                continue
            data, lo = ids.tobytes(), 0
            for i, hi in zip(some, stop, strict=True):
                self.known[units[i]] = data[lo:hi]
                lo = hi
        for at in range(0, len(other), 2000):
            some = other[at : at + 2000]
            got = self.tokenizer.encode_batch_fast([words[i] for i in some], add_special_tokens=False)
            self.known.update((units[i], np.array(e.ids, "<u4").tobytes()) for i, e in zip(some, got, strict=True))

    def __call__(self, texts: list[bytes | None]) -> list[bytes]:
        units = [units_of(t or b"") for t in texts]
        known = self.known
        if len(known) >= CACHE:
            known.clear()
            trim()
        if new := list(set().union(*units).difference(known)):
            self.learn(new)
        end = b"\0\0\0\0"
        return [b"".join(map(known.__getitem__, us)) + end for us in units]


_encoders: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and (part, nth): a number within the writing task for each length."""
    counts: dict[int, np.ndarray] = {}

    def run(c: dict) -> dict:
        if tokenizer not in _encoders:
            _encoders[tokenizer] = Encoder(tokenizer)
        task = TaskContext.get()
        key = task.taskAttemptId()
        if key not in counts:
            counts.clear()
            counts[key] = np.zeros(size + 1, np.int64)
        seen, rows = counts[key], []
        for doc, ids in zip(c["doc_id"], _encoders[tokenizer](c["text"]), strict=True):
            n = len(ids) // 4
            for k, start in enumerate(range(0, n, size)):
                part = ids[4 * start : 4 * (start + size)]
                length = len(part) // 4
                rows.append((doc, k, start, length, zlib.crc32(part), task.partitionId(), int(seen[length])))
                seen[length] += 1
        names = ("doc_id", "piece", "start", "length", "ids_crc32", "part", "nth")
        return dict(zip(names, zip(*rows, strict=True), strict=True))

    return mapped(texts(docs), run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def packed(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """``pieces`` (with length, part and nth) with sequence_id and offset; ``pieces`` must be a written table."""
    held = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = written(held.select("length", "part", (F.sum("n").over(_before()) - F.col("n")).alias("first")))
    counts = np.zeros(size + 1, np.int64)
    for r in held.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    key, sequence, offset, copies = slots(planned_runs(counts, size))
    rows = pieces.join(before.hint("merge"), ["length", "part"])  # grows with the tasks, so it is not broadcast
    rows = rows.withColumn("rank", F.col("nth") + F.col("first")).drop("first")
    names = [c for c in rows.columns if c not in ("part", "nth", "rank")]

    def place(batches):
        for b in batches:
            length = b["length"].to_numpy()
            want = (length << 40) | b["rank"].to_numpy()
            at = np.searchsorted(key, want, side="right") - 1
            extra = want - key[at]
            yield b[names].assign(sequence_id=sequence[at] + extra % copies[at], offset=offset[at] + extra // copies[at] * length)

    ordered = {f.name: f for f in rows.schema}
    schema = ", ".join(f"{n} {ordered[n].dataType.simpleString()}" for n in names) + ", sequence_id long, offset long"
    return rows.select(*names, "rank").mapInPandas(place, schema) if len(key) else rows.select(*names, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))


def _before() -> WindowSpec:
    return Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)


def best_fit_packing(docs: DataFrame, tokenizer: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every whole text."""
    tune(docs.sparkSession)
    cut = written(pieces(docs, tokenizer, size))
    return packed(cut, size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
