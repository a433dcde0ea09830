"""Chunks of documents, and exchanges of sorted keys between them.

Two operators ask which of very many keys (hashes of windows, suffixes of a parse) occur more than once in the corpus.
Documents are packed into chunks, written once as a bucketed table; every later pass recomputes a chunk's keys from its
texts, sends them to the task that owns their range of the hash space, and gets back some bits for each key. Keys travel
sorted and delta-coded, and each chunk sends a key once, with a mark if it has it twice, so frequent keys cost no more
than rare ones. Replies are joined to the bucketed table by chunk, which moves no texts. No pairs of occurrences are ever
made.

A sender emits at most ``FAN`` rows at a level. While ``FAN`` ranges are enough there is one level; beyond, the keys of
some ``FAN`` chunks meet in nodes of ``FAN`` ranges, where equal keys merge, and go on from there to finer ranges; the
replies come back the same way. So rows grow with the input, not with chunks times ranges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegrid.llm.common import mix, partitions, table_name, texts, trim, tune, written

#: Bytes of text in a chunk (a longer document is a chunk of its own).
CHUNK = 2 << 20
#: Chunks of a writing task that go to the same bucket: 2 to this power.
HOME = 2
#: Buckets of a table at most; beyond, a bucket holds more chunks.
BUCKETS = 20_000
#: Ranges that a sender emits at a level, and senders whose keys merge there.
FAN = 256
CHUNK_SCHEMA = "home long, part long, ids array<bigint>, sizes array<int>, data binary, carried array<array<string>>"
OWN = ("home", "part", "ids", "sizes", "data", "carried")


class Keys(NamedTuple):
    """Distinct rows (a 64-bit key and more 32-bit columns) in ascending order.

    ``asked``: which want a reply (None: all); ``several``: which the sender has twice or more (None: no one).
    """

    key: np.ndarray
    more: np.ndarray | None = None
    asked: np.ndarray | None = None
    several: np.ndarray | None = None


class Chunk(NamedTuple):
    ids: list[int | None]
    texts: list[bytes]
    carried: list[list[str | None]]


def unpacked(row: dict) -> Chunk:
    stop = np.cumsum(row["sizes"]).tolist()
    return Chunk(row["ids"], [row["data"][e - n : e] for n, e in zip(row["sizes"], stop, strict=True)], row["carried"])


def buckets(size: int) -> int:
    return max(1, min(BUCKETS, size))


def chunked(docs: DataFrame, carry: tuple[str, ...] = (), size: int = CHUNK) -> DataFrame:
    """Documents (null text: empty) packed into rows of about ``size`` bytes, as a table bucketed by ``home``.

    ``carry``: further columns that travel with the documents, as strings.
    """
    spark = docs.sparkSession
    tune(spark)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, held, total, more = TaskContext.get().partitionId() << 24, [], [], 0, [[] for _ in carry]

        def row() -> pa.RecordBatch:
            columns = ([part >> HOME], [part], [ids], [[len(t) for t in held]], [b"".join(held)], [more])
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.list_(pa.string())))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(OWN))

        for b in batches:
            for doc, text, *other in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and total + len(text or b"") > size:
                    yield row()
                    part, ids, held, total, more = part + 1, [], [], 0, [[] for _ in carry]
                for m, o in zip(more, other, strict=True):
                    m.append(o)
                ids.append(doc)
                held.append(text or b"")
                total += len(held[-1])
        if ids:
            yield row()

    name, path = table_name(spark)
    rows = texts(docs, *(F.col(c).cast("string").alias(f"carried_{i}") for i, c in enumerate(carry))).mapInArrow(pack, CHUNK_SCHEMA)
    n = buckets(partitions(docs, 8 << 20))
    rows.write.bucketBy(n, "home").option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._scratch = path
    return out


def coded(key: np.ndarray, low: int) -> bytes:
    """Sorted keys from ``low`` on as differences, byte plane by byte plane."""
    step = np.diff(key, prepend=np.uint64(low))
    width = max(1, -(-int(step.max()).bit_length() // 8)) if len(step) else 1
    return bytes([width]) + step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def decoded(data: bytes, n: int, low: int) -> np.ndarray:
    planes = np.zeros((n, 8), np.uint8)
    planes[:, : data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], n).T
    return np.cumsum(planes.view("<u8").ravel(), dtype=np.uint64) + np.uint64(low)


def replies(row: dict) -> dict[str, bytes]:
    return {n: v or b"" for n, v in row.items() if n not in OWN}


def to_reply(values: np.ndarray, bits: int) -> bytes:
    return np.packbits(values.astype(bool)).tobytes() if bits == 1 else values.astype(np.uint8).tobytes()


def from_reply(data: bytes, n: int, bits: int) -> np.ndarray:
    got = np.frombuffer(data, np.uint8)
    return np.unpackbits(got)[:n] if bits == 1 else got[:n]


def differing(key: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    """Which of the ordered rows differ from the one before."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    if more is not None:
        new[1:] |= (more[1:] != more[:-1]).any(axis=1)
    return new


def ordered(key: np.ndarray, more: np.ndarray | None) -> np.ndarray:
    """The order of rows by key, then by the further columns; runs that are in order already are merged."""
    order = np.argsort(key, kind="stable")
    if more is not None and len(key):
        k, m = key[order], more[order]
        tied = (k[1:] == k[:-1]) & (m[1:] != m[:-1]).any(axis=1)
        if tied.any():
            order = np.lexsort((*more.T[::-1], key))
    return order


def stacked(keys: list[Keys]) -> tuple[np.ndarray, np.ndarray | None, np.ndarray, np.ndarray]:
    """Keys, further columns, asked and several of all senders, one after another."""
    key = np.concatenate([k.key for k in keys])
    more = None if keys[0].more is None else np.concatenate([k.more for k in keys])
    asked = np.concatenate([np.ones(len(k.key), bool) if k.asked is None else k.asked for k in keys])
    several = np.concatenate([np.zeros(len(k.key), bool) if k.several is None else k.several for k in keys])
    return key, more, asked, several


def cut(values: np.ndarray, keys: list[Keys], asked: np.ndarray) -> list[np.ndarray]:
    """Values of all rows as replies to the senders, to the asked rows only."""
    stop = np.cumsum([len(k.key) for k in keys])
    return [values[e - len(k.key) : e][asked[e - len(k.key) : e]] for k, e in zip(keys, stop.tolist(), strict=True)]


def repeated(keys: list[Keys]) -> list[np.ndarray]:
    """1 for rows that occur twice or more, whether in one chunk or in several."""
    key, more, asked, several = stacked(keys)
    if not len(key):
        return cut(np.zeros(0, np.uint8), keys, asked)
    order = ordered(key, more)
    new = differing(key[order], None if more is None else more[order])
    times = np.add.reduceat(1 + several[order], np.flatnonzero(new))
    again = np.empty(len(key), np.uint8)
    again[order] = (times > 1)[np.cumsum(new) - 1]
    return cut(again, keys, asked)


def distinct(key: np.ndarray, more: np.ndarray | None = None) -> tuple[Keys, np.ndarray]:
    """The distinct rows with their several marks, and each row's place among them."""
    order = ordered(key, more)
    k, m = key[order], None if more is None else more[order]
    new = differing(k, m)
    place = np.empty(len(key), np.int64)
    place[order] = np.cumsum(new) - 1
    times = np.bincount(place, minlength=int(new.sum()))
    return Keys(k[new], None if m is None else m[new], None, times > 1), place


def union(keys: list[Keys]) -> tuple[Keys, list[np.ndarray]]:
    """The senders' rows merged, and the places of each sender's rows that want a reply among the replies to come."""
    key, more, asked, several = stacked(keys)
    whole, place = distinct(key, more)
    n = len(whole.key)
    wants = np.bincount(place[asked], minlength=n) > 0
    twice = whole.several | (np.bincount(place[several], minlength=n) > 0)
    at = np.cumsum(wants) - 1
    return Keys(whole.key, whole.more, wants, twice), cut(at[place], keys, asked)


NODE = "g long, r long"
KEY_ROWS = f"{NODE}, sg long, sr long, n int, low long, keys binary, width int, more binary, bits binary"
ANSWER_ROWS = f"{NODE}, at long, n int, reply binary"
KEY_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
ANSWER_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def batch(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def rows_of(k: Keys, group: int, sender: tuple[int, int], ranges: int) -> list[tuple]:
    """The keys as one row for each range of the hash space that has any."""
    where = (k.key >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)
    start = np.flatnonzero(differing(where, None))
    out = []
    for lo, hi in zip(start.tolist(), [*start[1:].tolist(), len(where)], strict=True):
        more = b"" if k.more is None else k.more[lo:hi].astype("<u4").T.tobytes()
        marks = [np.ones(hi - lo, bool) if k.asked is None else k.asked[lo:hi], np.zeros(hi - lo, bool) if k.several is None else k.several[lo:hi]]
        low = int(k.key[lo])
        out.append((group, int(where[lo]), *sender, hi - lo, low - (1 << 64) if low >> 63 else low, coded(k.key[lo:hi], low), 0 if k.more is None else k.more.shape[1], more, np.packbits(np.concatenate(marks)).tobytes()))
    return out


def keys_of(x: dict) -> Keys:
    n = x["n"]
    marks = np.unpackbits(np.frombuffer(x["bits"], np.uint8))[: 2 * n].astype(bool)
    more = np.frombuffer(x["more"], "<u4").reshape(x["width"], n).T if x["width"] else None
    return Keys(decoded(x["keys"], n, x["low"] % (1 << 64)), more, marks[:n], marks[n:])


def by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of each node; batches come sorted by node."""
    held: list[dict] = []
    for b in batches:
        for x in b.to_pylist():
            if held and (held[0]["g"], held[0]["r"]) != (x["g"], x["r"]):
                yield held
                held = []
                trim()
            held.append(x)
    if held:
        yield held


def dealt(rows: DataFrame, tasks: int, *order: str) -> DataFrame:
    """Nodes dealt to tasks evenly by their numbers, sorted within."""
    spread = F.pmod(F.col("g") * F.lit(FAN + 1) + F.col("r"), F.lit(tasks)).cast("int")
    return rows.repartitionById(tasks, spread).sortWithinPartitions("g", "r", *order)


def exchanged(chunks: DataFrame, name: str, make: Callable[[Chunk, dict[str, bytes]], Keys], solve: Callable[[list[Keys]], list[np.ndarray]] = repeated, ranges: int = 16, bits: int = 1, fan: int = FAN) -> DataFrame:
    """``chunks`` with the replies to the keys that ``make`` draws from each (given earlier replies) as column ``name``.

    ``ranges`` parts of the hash space are solved one by one; their number follows the input's size. ``bits`` of a reply: 1 or 8.
    """
    levels = 1
    while fan**levels < ranges:
        levels += 1
    tasks, several = min(ranges, BUCKETS), 1
    if levels > 1:  # writing tasks whose chunks, some ``fan`` of them, merge at the first level
        made = chunks.agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.shiftright("part", 24)).alias("tasks")).first()
        several = max(1, fan * made["tasks"] // max(made["n"], 1))
    width = [min(ranges, fan ** (i + 1)) for i in range(levels)]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                k = make(unpacked(c), replies(c))
                group = (c["part"] >> 24) // several if levels > 1 else 0
                rows = rows_of(k, group, (c["part"], 0), width[0])
                del k
                trim()
                if rows:
                    yield batch(rows, KEY_KINDS, KEY_ROWS)

    sent, inner = chunks.mapInArrow(send, KEY_ROWS), []
    for level in range(1, levels):

        def forward(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for held in by_node(batches):
                k, _ = union([keys_of(x) for x in held])
                node = held[0]["g"], held[0]["r"]
                yield batch(rows_of(k, node[0] // fan if level < levels - 1 else 0, node, width[level]), KEY_KINDS, KEY_ROWS)

        inner.append(written(sent))  # read twice: on the way there and on the way back
        sent = dealt(inner[-1], tasks, "sg", "sr").mapInArrow(forward, KEY_ROWS)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in by_node(batches):
            found = solve([keys_of(x) for x in held])
            yield batch([(x["sg"], x["sr"], x["r"], len(f), to_reply(f, bits)) for x, f in zip(held, found, strict=True)], ANSWER_KINDS, ANSWER_ROWS)

    answers = dealt(sent, tasks, "sg", "sr").mapInArrow(answer, ANSWER_ROWS)
    for rows in reversed(inner):

        def back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for held in by_node(batches):
                asking, got = [x for x in held if x["at"] is None], [x for x in held if x["at"] is not None]
                _, places = union([keys_of(x) for x in asking])
                values = np.concatenate([from_reply(x["reply"], x["n"], bits) for x in got])
                yield batch([(x["sg"], x["sr"], x["r"], len(p), to_reply(values[p], bits)) for x, p in zip(asking, places, strict=True)], ANSWER_KINDS, ANSWER_ROWS)

        both = rows.unionByName(answers, allowMissingColumns=True)
        answers = dealt(both, tasks, "at", "sg", "sr").mapInArrow(back, ANSWER_ROWS)
    # One row a chunk: the replies of its ranges in their order, which is the order of the chunk's keys; at most ``fan``.
    whole = answers.groupBy(F.col("g").alias("part")).agg(F.array_sort(F.collect_list(F.struct("at", "n", "reply"))).alias("got"))

    def join_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [to_reply(np.concatenate([from_reply(g["reply"], g["n"], bits) for g in got]), bits) for got in b.column(1).to_pylist()]
            parts = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([p >> HOME for p in parts], pa.int64()), b.column(0), pa.array(out, pa.binary())], names=["home", "part", name])

    got = written(whole.mapInArrow(join_bits, f"home long, part long, {name} binary"))
    return chunks.join(got.hint("shuffle_hash"), ["home", "part"], "left")


def finished(chunks: DataFrame, fn: Callable[[Chunk, dict[str, bytes]], dict], schema: str) -> DataFrame:
    """One row for each document: ``fn`` of each chunk and its replies gives columns as lists."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
                out = fn(unpacked(c), replies(c))
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)
                del out
                trim()

    return chunks.mapInArrow(run, schema)


#: Odd bases of the polynomial window hashes.
BASE, SECOND = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
INVERSE = pow(BASE, -1, 1 << 64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_powers: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}


def prefix_sums(x: np.ndarray, base: int = BASE) -> tuple[np.ndarray, np.ndarray]:
    """(sums, inverse powers): the hash of x[i:j] is (sums[j] - sums[i]) * inverse[i], the same wherever x[i:j] occurs."""
    n = 1 << (len(x) + 1).bit_length()
    if (n, base) not in _powers:
        if len(_powers) > 6:
            _powers.clear()
        _powers[n, base] = (powers(base, n), powers(pow(base, -1, 1 << 64), n))
    up, down = _powers[n, base]
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x * up[: len(x)], out=sums[1:])
    return sums, down


def window_hashes(sums: np.ndarray, down: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    return mix((sums[start + size] - sums[start]) * down[start])


def wide_hashes(x: np.ndarray, sums: np.ndarray, down: np.ndarray, start: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each window of ``x``: its hash by the first base, and that by the second as two columns."""
    second = window_hashes(*prefix_sums(x, SECOND), start, size)
    return window_hashes(sums, down, start, size), second.view(np.uint32).reshape(-1, 2)


def covered(flags: np.ndarray, size: int) -> np.ndarray:
    """Positions covered by windows of ``size`` whose starts are flagged; flags has one entry a position."""
    edge = np.zeros(len(flags) + size + 1, np.int32)
    at = np.flatnonzero(flags)
    edge[at] += 1
    edge[at + size] -= 1
    return np.cumsum(edge)[: len(flags)] > 0
