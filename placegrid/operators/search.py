"""Exact k nearest neighbours (squared L2) that visit only what can hold one.

References are dealt to cells around pivots (a bounded number of reference vectors, drawn by a hash of the key) and packed
into blocks of one cell, ordered by their distance from the pivot; a block knows the least and largest of these distances,
so that a cell of any size, or of copies of one vector, is many blocks of bounded size. By the triangle inequality no
vector of a block is nearer to a query than the query's distance from the pivot is outside that range.

Blocks that follow each other lie together in tiles of about ``TILE`` bytes. A first round searches, for each query, the
blocks around it in the nearest cells until they hold k references. Its k-th distance bounds the answer. For the second
round queries are packed by cell, also in about ``TILE`` bytes, and each pack goes to the tiles that the bounds of some of its
queries leave; there each query visits the blocks that its bound leaves, which shrinks as it finds. A top-k merges the tiles.
So no row is made for a query and a block: what is shuffled grows with the pairs of packs and tiles. References of up to
``SMALL`` bytes, which are counted first, are one broadcast table instead. The driver holds a row for each tile and cell.

Distances that are returned are sums of squared differences in double precision; ties are broken by the target's key.
Products only shortlist, around each block's centre and with a slack above their rounding error, so large coordinates do no
harm. Rows whose vector is NULL, has NULL, NaN or infinite values or another length than ``size`` (by default the most
frequent among the references) are neither queries nor references; ``vectors.unusable`` reports them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from placegrid.scratch import discard, written

#: Rows of a block at most.
BLOCK = 4096
#: References of up to so many bytes are broadcast.
SMALL = 16 << 20
#: Pivots at most, and their bytes.
PIVOTS, PIVOT_BYTES = 1024, 16 << 20
#: Bytes of vectors in a tile or a pack of queries, about; of the packs that meet a copy of a tile.
TILE, MEETING = 8 << 20, 64 << 20
#: Queries and references that are multiplied at once, so that products stay in a processor's cache.
ABREAST, ACROSS = 512, 1024
#: Relative slack of bounds on distances, far above the rounding of their sums.
SLACK = 1e-9

PACKED = "n int, keys array<long>, vectors binary"
FOUND = "query long, target long, d2 double"


def usable(rows: DataFrame, vector: str, size: int) -> DataFrame:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col(vector).isNotNull() & (F.size(vector) == size) & ~bad)


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The vectors of an Arrow batch as rows of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def stored(rows: DataFrame, vector: str) -> str:
    """How vectors travel: in four bytes a number if they have no more."""
    return "<f4" if isinstance(rows.schema[vector].dataType.elementType, FloatType) else "<f8"


def unpacked(data: bytes, size: int, kind: str = "<f8") -> np.ndarray:
    return np.frombuffer(data, kind).astype(np.float64, copy=False).reshape(-1, size)


KINDS = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
KINDS |= {f"array<{k}>": pa.list_(v) for k, v in KINDS.items()}


def record(columns: list, schema: str) -> pa.RecordBatch:
    """Columns as an Arrow batch of a schema of KINDS."""
    fields = [f.split(" ") for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def packed(rows: DataFrame, key: str, vector: str, size: int, block: int) -> DataFrame:
    """Rows packed into blocks within their partitions: n, keys, vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, keys = matrix(b.column(1), size), b.column(0).to_pylist()
            for at in range(0, len(keys), block):
                own = keys[at : at + block]
                yield record([[len(own)], [own], [x[at : at + block].tobytes()]], PACKED)

    return rows.select(F.col(key).cast("long"), vector).mapInArrow(run, PACKED)


def least(row: np.ndarray, key: np.ndarray, d2: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k least of each row by (distance, key), in order."""
    order = np.lexsort((key, d2, row))
    row, key, d2 = row[order], key[order], d2[order]
    rank = np.arange(len(row)) - np.searchsorted(row, row)
    return row[rank < k], key[rank < k], d2[rank < k]


def shortlist(q: np.ndarray, t: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, reference row, squared distance) of pairs within ``limit``, among them each query's k nearest with all ties."""
    middle = t.mean(0)
    a, b = q - middle, t - middle  # products round relative to these lengths
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    near = np.c_[-2 * a, np.ones(len(a))] @ np.c_[b, b2].T  # less the query's own length
    slack = 8e-16 * (q.shape[1] + 8) * (a2 + b2.max())
    most = limit - a2 + slack
    inside = near <= most[:, None]
    many = np.flatnonzero(np.count_nonzero(inside, axis=1) > 2 * k)
    if len(many):
        own = near[many]
        inside[many] &= own <= (np.partition(own, k - 1, axis=1)[:, k - 1] + slack[many])[:, None]
    row, col = np.nonzero(inside)
    d2 = ((q[row] - t[col]) ** 2).sum(1)
    within = d2 <= limit[row]
    return row[within], col[within], d2[within]


class Best:
    """The nearest that each of some queries has found so far, and its limit, which shrinks."""

    def __init__(self, q: np.ndarray, k: int, limit: np.ndarray) -> None:
        self.q, self.k, self.limit = q, k, limit.copy()
        self.row, self.key, self.d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def meet(self, t: np.ndarray, keys: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Some of the queries (all) meet references."""
        for lo in range(0, len(t), ACROSS):
            some = slice(lo, lo + ACROSS)
            q, limit = (self.q, self.limit) if rows is None else (self.q[rows], self.limit[rows])
            row, col, d2 = shortlist(q, t[some], self.k, limit)
            if len(row):
                row = row if rows is None else rows[row]
                found = np.r_[self.row, row], np.r_[self.key, keys[some][col]], np.r_[self.d2, d2]
                self.row, self.key, self.d2 = least(*found, self.k)
                last = np.flatnonzero(np.r_[self.row[1:] != self.row[:-1], True])
                full = np.diff(last, prepend=-1) == self.k
                self.limit[self.row[last[full]]] = self.d2[last[full]]


def nearest(q: np.ndarray, t: np.ndarray, keys: np.ndarray, k: int, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, key, squared distance) of each query's k least by (distance, key) that are within ``limit``."""
    out = []
    for lo in range(0, len(q), ABREAST):
        best = Best(q[lo : lo + ABREAST], k, limit[lo : lo + ABREAST])
        best.meet(t, keys)
        out.append((best.row + lo, best.key, best.d2))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def top_k(found: DataFrame, k: int, query: str = "query", target: str = "target") -> DataFrame:
    """The k smallest d2 of each query, ties by target."""
    rank = F.row_number().over(Window.partitionBy(query).orderBy("d2", target))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select(query, "rank", target, "d2")


class Blocks(NamedTuple):
    """What is known of blocks, or of a tile's part of a cell, without their vectors."""

    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def away(self, q: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """Distances of queries from the pivots of the blocks (query x block)."""
        cells, of = np.unique(self.cell, return_inverse=True)
        return np.stack([np.sqrt(((q - pivots[c]) ** 2).sum(1)) for c in cells], 1)[:, of]

    def gap(self, away: np.ndarray) -> np.ndarray:
        """Less than the distance of a query from any vector of a block."""
        return np.maximum(np.maximum(away - self.high, self.low - away), 0)

    def around(self, away: np.ndarray, gap: np.ndarray, k: int) -> np.ndarray:
        """Whether a block is among those of the nearest cells around a query that hold its first k references."""
        order = np.lexsort((gap, away), axis=1)
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.empty(order.shape, bool)
        np.put_along_axis(out, order, before < k, 1)
        return out

    @staticmethod
    def left(away: np.ndarray, gap: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Whether a block may hold what is within the bound, a squared distance."""
        near = np.sqrt(bound)[:, None]
        return gap <= near + SLACK * (away + near)


class Index(NamedTuple):
    """Tiles, a written table, how they store vectors, and what the driver keeps: the pivots, and the parts of cells in tiles."""

    tiles: DataFrame
    kind: str
    pivots: np.ndarray
    tile: np.ndarray
    parts: Blocks


TILES = "tile long, cells array<int>, low array<double>, high array<double>, rows array<int>, keys binary, vectors binary"


def indexed(references: DataFrame, target: str, vector: str, size: int, total: int, block: int = BLOCK) -> Index:
    """An index of usable references, ``total`` of them."""
    n = int(max(1, min(PIVOTS, PIVOT_BYTES // (8 * size + 1), -(-2 * total // block))))
    drawn = references.select(F.col(target).cast("long").alias("k"), vector).orderBy(F.xxhash64("k"), "k").limit(n).collect()  # bounded in number and bytes
    pivots = np.array([r[1] for r in drawn], np.float64).reshape(-1, size)
    middle = pivots.mean(0)
    shifted = pivots - middle
    lengths = (shifted * shifted).sum(1)
    kind = stored(references, vector)
    most = max(1, TILE // (np.dtype(kind).itemsize * size + 8))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), size)
            cell = (lengths - 2 * ((x - middle) @ shifted.T)).argmin(1)
            away = np.sqrt(((x - pivots[cell]) ** 2).sum(1))
            yield record([cell, away, b.column(0), [v.tobytes() for v in x.astype(kind)]], "cell int, away double, k long, v binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held = TaskContext.get().partitionId() << 32, []

        def row() -> pa.RecordBatch:
            cell, away, keys, data = zip(*held, strict=True)
            starts = [0]
            for i in range(1, len(held)):
                if cell[i] != cell[starts[-1]] or i - starts[-1] == block:
                    starts.append(i)
            last = [i - 1 for i in (*starts[1:], len(held))]
            columns = ([cell[i] for i in starts], [away[i] for i in starts], [away[i] for i in last], [j - i + 1 for i, j in zip(starts, last, strict=True)], np.array(keys, "<i8").tobytes(), b"".join(data))
            return record([[tile], *([c] for c in columns)], TILES)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held.append(r)
                if len(held) == most:
                    yield row()
                    tile, held = tile + 1, []
        if held:
            yield row()

    dealt = references.select(F.col(target).cast("long"), vector).mapInArrow(assign, "cell int, away double, k long, v binary")
    tasks = max(references.sparkSession.sparkContext.defaultParallelism, -(-total // most))
    tiles = written(dealt.repartitionByRange(tasks, "cell", "away", "k").sortWithinPartitions("cell", "away", "k").mapInArrow(pack, TILES))
    blocks = tiles.select("tile", F.explode(F.arrays_zip("cells", "low", "high", "rows")).alias("b"))
    parts = blocks.groupBy("tile", "b.cells").agg(F.min("b.low"), F.max("b.high"), F.sum("b.rows")).orderBy("tile", "cells").collect()  # at most one row a tile and a pivot
    tile, cell, low, high, rows = (np.array(c) for c in zip(*parts, strict=True)) if parts else (np.zeros(0, int),) * 5
    return Index(tiles, kind, pivots, tile, Blocks(cell, low, high, rows))


ASKING = "tile long, ids binary, vs binary, bounds binary"


def packs(asking: DataFrame, by: str, width: int, n: int, parts: bool) -> DataFrame:
    """Rows (``by``, query, v of so many bytes, bound) packed in the order of ``by``; packs of one value of it only, if ``parts``."""
    most = max(1, TILE // (width + 16))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def row() -> pa.RecordBatch:
            at, ids, vs, bounds = zip(*held, strict=True)
            return record([[at[0]], [np.array(ids, "<i8").tobytes()], [b"".join(vs)], [np.array(bounds, "<f8").tobytes()]], ASKING)

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (len(held) == most or (parts and r[0] != held[0][0])):
                    yield row()
                    held = []
                held.append(r)
        if held:
            yield row()

    rows = asking.select(F.col(by).cast("long").alias("tile"), "query", "v", "bound")
    tasks = max(asking.sparkSession.sparkContext.defaultParallelism, -(-n // most))
    return rows.repartitionByRange(tasks, "tile", "query").sortWithinPartitions("tile", "query").mapInArrow(run, ASKING)


def pieces(row: dict, size: int, kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A pack's ids, vectors and bounds, ``ABREAST`` queries at once."""
    ids, q, bounds = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vs"], kind).reshape(-1, size), np.frombuffer(row["bounds"], "<f8")
    for lo in range(0, len(ids), ABREAST):
        yield ids[lo : lo + ABREAST], q[lo : lo + ABREAST].astype(np.float64), bounds[lo : lo + ABREAST]


def dealt(packs_: DataFrame, index: Index, size: int, kind: str) -> DataFrame:
    """Packs of queries as rows for each tile that some of their bounds leave, with those queries."""
    pivots, tile, known = index.pivots, index.tile, index.parts
    tiles, first = np.unique(tile, return_index=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                need = []
                for _, q, bounds in pieces(row, size, kind):
                    away = known.away(q, pivots)
                    need.append(np.logical_or.reduceat(known.left(away, known.gap(away), bounds), first, axis=1))
                ids, q, bounds, need = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["vs"], kind).reshape(-1, size), np.frombuffer(row["bounds"], "<f8"), np.concatenate(need)
                for i in np.flatnonzero(need.any(0)):
                    own = need[:, i]
                    yield record([[int(tiles[i])], [ids[own].tobytes()], [q[own].tobytes()], [bounds[own].tobytes()]], ASKING)

    return packs_.mapInArrow(run, ASKING)


def met(asking: DataFrame, tiles: DataFrame, total: int, columns: tuple[str, ...]) -> DataFrame:
    """Packs joined with the tile that they are for; a tile that many packs (``total`` bytes) may meet is dealt in copies."""
    salts = max(1, total // MEETING)
    asking = asking.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts)))
    tiles = tiles.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    return asking.join(tiles.hint("shuffle_merge"), ["tile", "salt"]).select("ids", "vs", "bounds", *columns)


def visited(asking: DataFrame, index: Index, n: int, size: int, kind: str, k: int, first: bool, counted: bool = False) -> DataFrame:
    """query, target, d2: for each pack and its tile each query's k nearest of the blocks that it visits.

    The first round visits the blocks around a query until they hold k references, the second those that the bound leaves.
    ``counted``: query, target and d2 are instead a tile's number, queries that come and the blocks that they visit.
    """
    pivots, stored_as = index.pivots, index.kind

    def visit(q: np.ndarray, bounds: np.ndarray, known: Blocks, t: np.ndarray, keys: np.ndarray) -> tuple[Best, int]:
        best, away, end, visits = Best(q, k, bounds), known.away(q, pivots), np.cumsum(known.rows), 0
        gap = known.gap(away)
        around = known.around(away, gap, k) if first else None
        cuts = [0]  # runs of blocks of a cell
        for i in range(1, len(end)):
            if known.cell[i] != known.cell[i - 1] or end[i] - (end[cuts[-1]] - known.rows[cuts[-1]]) > ACROSS:
                cuts.append(i)
        order = np.argsort(np.minimum.reduceat(gap.mean(0), cuts), kind="stable")
        cuts.append(len(end))
        for c in order.tolist():
            run = slice(cuts[c], cuts[c + 1])
            need = around[:, run] if first else known.left(away[:, run], gap[:, run], best.limit)
            visits += int(np.count_nonzero(need))
            rows, blocks = np.flatnonzero(need.any(1)), np.flatnonzero(need.any(0)) + run.start
            if len(rows):
                if len(blocks) == run.stop - run.start:
                    at = slice(end[run.start] - known.rows[run.start], end[run.stop - 1])
                else:
                    at = np.concatenate([np.arange(end[i] - known.rows[i], end[i]) for i in blocks])
                best.meet(t[at], keys[at], None if len(rows) == len(q) else rows)
        return best, visits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)}
                known = Blocks(*(np.array(row[c]) for c in ("cells", "low", "high", "rows")))
                t, keys = unpacked(row["vectors"], size, stored_as), np.frombuffer(row["keys"], "<i8")
                for ids, q, bounds in pieces(row, size, kind):
                    best, visits = visit(q, bounds, known, t, keys)
                    yield record([[0], [len(ids)], [float(visits)]] if counted else [ids[best.row], best.key, best.d2], FOUND)

    return met(asking, index.tiles, n * size * np.dtype(kind).itemsize, ("cells", "low", "high", "rows", "keys", "vectors")).mapInArrow(run, FOUND)


def pruned(queries: DataFrame, index: Index, k: int, query: str, vector: str, size: int, counted: bool = False) -> DataFrame:
    """query, rank, target, d2, a written table; ``counted``: instead (n, visits) of each round, the queries and the pairs with blocks visited."""
    pivots, tile, known, kind = index.pivots, index.tile, index.parts, stored(queries, vector)
    width = size * np.dtype(kind).itemsize
    schema = "query long, v binary, cell int, tile long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with their nearest cell, once for each tile of their first round."""
        for b in batches:
            x, keys = matrix(b.column(1), size), b.column(0).to_numpy()
            for lo in range(0, len(x), ABREAST):
                q = x[lo : lo + ABREAST]
                away = known.away(q, pivots)
                own, at = np.nonzero(known.around(away, known.gap(away), k))
                data = [v.tobytes() for v in q.astype(kind)]
                yield record([keys[lo + own], [data[i] for i in own], known.cell[away.argmin(1)][own], tile[at]], schema)

    if not len(tile):
        return queries.sparkSession.createDataFrame([], "n long, visits long" if counted else "query long, rank int, target long, d2 double")
    first = written(queries.select(F.col(query).cast("long"), vector).mapInArrow(place, schema).distinct())
    asking = first.select("query", "v", "cell").distinct()
    n = asking.count()
    everywhere = packs(first.withColumn("bound", F.lit(float("inf"))), "tile", width, n, True)
    found = visited(everywhere, index, n, size, kind, k, True)
    near = found.groupBy("query").agg(F.sort_array(F.collect_list("d2")).alias("d2"))  # at most k a tile
    bound = F.coalesce(F.try_element_at("d2", F.lit(k)), F.lit(float("inf"))) * (1 + SLACK)
    second = dealt(packs(asking.join(near, "query").select("query", "v", "cell", bound.alias("bound")), "cell", width, n, False), index, size, kind)
    if counted:
        rounds = [visited(everywhere, index, n, size, kind, k, True, True), visited(second, index, n, size, kind, k, False, True)]
        out = written(rounds[0].unionByName(rounds[1]).agg(F.lit(n).cast("long").alias("n"), F.coalesce(F.sum("d2"), F.lit(0)).cast("long").alias("visits")))
    else:
        out = written(top_k(visited(second, index, n, size, kind, k, False), k))
    discard(first)
    return out


def lengths(references: DataFrame, vector: str) -> tuple[int, int]:
    """The most frequent length of the references' vectors, and how many have it."""
    most = references.groupBy(F.size(vector).alias("size")).agg(F.count(F.lit(1)).alias("n")).where("size > 0").orderBy(F.desc("n"), F.desc("size")).first()
    return (most["size"], most["n"]) if most else (1, 0)


def knn(queries: DataFrame, references: DataFrame, k: int, query: str = "query", target: str = "target", vector: str = "features", block: int = BLOCK, size: int | None = None, small: int = SMALL) -> DataFrame:
    """query, rank (from 1), target, d2 of the k nearest references; min(k, references) rows a query. Keys are longs."""
    found, total = lengths(references, vector)
    size = size or found
    own, all_ = usable(queries, vector, size), usable(references, vector, size)
    if total * size * 8 <= small:
        pairs = packed(own, query, vector, size, 1024).toDF("qn", "asking", "qs").join(F.broadcast(packed(all_, target, vector, size, block)), F.lit(True))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    ids, qs, keys, ts = (b.column(j)[i].as_py() for j in range(4))
                    row, key, d2 = nearest(unpacked(qs, size), unpacked(ts, size), np.array(keys, np.int64), k, np.full(len(ids), np.inf))
                    yield record([np.array(ids, np.int64)[row], key, d2], f"{query} long, {target} long, d2 double")

        return top_k(pairs.select("asking", "qs", "keys", "vectors").mapInArrow(run, f"{query} long, {target} long, d2 double"), k, query, target)
    index = indexed(all_, target, vector, size, total, block)
    rows = pruned(own, index, k, query, vector, size)
    discard(index.tiles)
    return rows.withColumnsRenamed({"query": query, "target": target})


def visits(queries: DataFrame, references: DataFrame, k: int, query: str = "query", target: str = "target", vector: str = "features", block: int = BLOCK, size: int | None = None) -> DataFrame:
    """One row: queries, blocks, pairs of them that a search visits, and the share of all pairs."""
    found, total = lengths(references, vector)
    size = size or found
    index = indexed(usable(references, vector, size), target, vector, size, total, block)
    counts = pruned(usable(queries, vector, size), index, k, query, vector, size, counted=True)
    counts = counts.crossJoin(index.tiles.agg(F.coalesce(F.sum(F.size("cells")), F.lit(0)).alias("blocks")))  # one row each
    return counts.select(F.col("n").alias("queries"), "blocks", F.col("visits").alias("visited"), F.try_divide("visits", F.col("n") * F.col("blocks")).alias("share"))


def knn_within(queries: DataFrame, references: DataFrame, k: int, by: str, query: str = "query", target: str = "target", vector: str = "features") -> DataFrame:
    """The same among the references of a query's own value of ``by``, an integer (NULL: none); queries without any drop out.

    References and queries are packed by it, and each pack meets the tiles of its value. No row is made for a pair.
    """
    size, total = lengths(references, vector)
    kind = {"query": stored(queries, vector), "target": stored(references, vector)}

    def flat(rows: DataFrame, key: str, side: str) -> DataFrame:
        as_ = kind[side]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield record([b.column(0), b.column(1), [v.tobytes() for v in matrix(b.column(2), size).astype(as_)], np.full(b.num_rows, np.inf)], "by long, query long, v binary, bound double")

        rows = usable(rows.where(F.col(by).isNotNull()), vector, size)
        return rows.select(F.col(by).cast("long"), F.col(key).cast("long"), vector).mapInArrow(run, "by long, query long, v binary, bound double")

    width = {side: size * np.dtype(as_).itemsize for side, as_ in kind.items()}
    tiles = packs(flat(references, target, "target"), "by", width["target"], total, True)
    tiles = written(tiles.select(F.col("tile").alias("by"), F.monotonically_increasing_id().alias("tile"), F.col("ids").alias("keys"), F.col("vs").alias("vectors")))
    n = queries.count()
    asking = packs(flat(queries, query, "query"), "by", width["query"], n, True).withColumnRenamed("tile", "by")
    asking = asking.join(F.broadcast(tiles.select("by", "tile")), "by").select("tile", "ids", "vs", "bounds")  # one row a tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {name: b.column(j)[i].as_py() for j, name in enumerate(b.schema.names)}
                t, keys = unpacked(row["vectors"], size, kind["target"]), np.frombuffer(row["keys"], "<i8")
                for ids, q, bounds in pieces(row, size, kind["query"]):
                    at, key, d2 = nearest(q, t, keys, k, bounds)
                    yield record([ids[at], key, d2], FOUND)

    found = met(asking, tiles, n * width["query"], ("keys", "vectors")).mapInArrow(run, FOUND)
    out = written(top_k(found, k))
    discard(tiles)
    return out.withColumnsRenamed({"query": query, "target": target})
