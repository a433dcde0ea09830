"""SimHash near-duplicates through BK-trees.

Fingerprints: lower-cased (A-Z only) words, 4-word shingles (repeats count), XXH64 with seed 42; a bit is 1 if more
than half of the shingle hashes have it. Fingerprints within ``radius`` bits link; components are the transitive
closure.

Distributed form: fingerprints are made distinct first, so exact copies never meet. By the pigeonhole principle two
fingerprints within ``radius`` bits agree on ``equal`` of ``radius + equal`` blocks, so each distinct fingerprint goes
to one shard per choice of ``equal`` blocks. Each shard holds a BK-tree (children keyed by their integer Hamming
distance to the parent) which its members search, following only the edges within the radius. A tree over all
fingerprints would grow with the corpus, so none is broadcast; the trees stay in the tasks that own their shards.
``equal`` grows with the number of fingerprints and holds the mean shard under a constant; a shard of more than ``HOT``
members is split by the same principle on its other bits. Shards report spanning stars, not pairs, and a label
propagation with pointer jumping joins the stars.

Nulls and edges: a null or blank text has fingerprint zero and links like any other; a null doc_id is kept, but cannot
name a component (a component of null ids only is null); repeated rows are each returned; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegrid.llm.common import discard, mapped, partitions, salted_join, texts, tune, written

SEED, SHINGLE, RADIUS = 42, 4, 4
#: Mean members of a shard above which one more block must agree.
SHARD = 64
#: Members above which a single shard is split.
HOT = 20_000
#: Frontier entries of the tree search held at once.
FRONTIER = 1 << 20


def fingerprint(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles of one text, as unsigned 64-bit."""
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts, ends = [0, *(gaps + 1).tolist()], [*gaps.tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[s:e], SEED) for s, e in zip(starts, ends[shingle - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as signed 64-bit."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (signed 64-bit) of every whole text."""

    def run(c: dict) -> dict:
        return {"doc_id": c["doc_id"], "fp": [majority(fingerprint((t or b"").lower().split(), shingle)) for t in c["text"]]}

    return mapped(texts(docs), run, "doc_id long, fp long")


def bk_forest(fps: np.ndarray, root: np.ndarray) -> np.ndarray:
    """BK-trees of many shards at once; ``root[i]`` is the first member of i's shard.

    Returns child[node, distance] (-1: none). Level by level, the first of those that arrive at a node with the same
    distance becomes its child, the others descend into it.
    """
    child = np.full((len(fps), 65), -1, np.int32)
    left = np.flatnonzero(root != np.arange(len(fps)))
    at = root[left]
    while len(left):
        d = np.bitwise_count(fps[left] ^ fps[at]).astype(np.int64)
        key = at.astype(np.int64) * 65 + d
        order = np.argsort(key, kind="stable")
        first = np.ones(len(order), bool)
        first[1:] = key[order][1:] != key[order][:-1]
        heads = order[first]
        child[at[heads], d[heads]] = left[heads]
        stay = np.ones(len(left), bool)
        stay[heads] = False
        left, at = left[stay], child[at[stay], d[stay]]
    return child


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Union of the pairs (a, b) into a forest of minimum labels, by hooking and compression."""
    while True:
        x, y = label[a], label[b]
        go = x != y
        if not go.any():
            return label
        a, b, x, y = a[go], b[go], x[go], y[go]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while (new := label[label]) is not None and (new != label).any():
            label = new


def tree_hits(fps: np.ndarray, child: np.ndarray, q: np.ndarray, root: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (query, node) within ``radius`` bits, found by following only the edges within it from the queries' roots."""
    steps = np.arange(-radius, radius + 1)
    todo = [(q, root)]
    while todo:
        q, node = todo.pop()
        if len(q) > FRONTIER // len(steps):
            half = len(q) // 2
            todo += [(q[:half], node[:half]), (q[half:], node[half:])]
            continue
        d = np.bitwise_count(fps[q] ^ fps[node]).astype(np.int64)
        hit = d <= radius
        yield q[hit], node[hit]
        edges = d[:, None] + steps
        nxt = np.where((edges >= 1) & (edges <= 64), child[node[:, None], np.clip(edges, 0, 64)], -1)
        row, col = np.nonzero(nxt >= 0)
        if len(row):
            todo.append((q[row], nxt[row, col]))


def shard_links(fps: np.ndarray, root: np.ndarray, radius: int) -> np.ndarray:
    """For each member the least index of its component within its shard, found by searching the shard's BK-tree."""
    label = np.arange(len(fps))
    for a, b in tree_hits(fps, bk_forest(fps, root), np.arange(len(fps)), root, radius):
        label = joined(label, a, b)
    return label


def block_keys(equal: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each choice of ``equal`` of ``radius + equal`` blocks: its (shift, width) parts."""
    n = radius + equal
    cuts = [64 * i // n for i in range(n + 1)]
    return [[(cuts[i], cuts[i + 1] - cuts[i]) for i in c] for c in combinations(range(n), equal)]


def other_blocks(parts: list[tuple[int, int]], n: int) -> list[list[tuple[int, int]]]:
    """The bits outside ``parts`` in ``n`` blocks, each as (shift, width) parts."""
    used = {b for shift, width in parts for b in range(shift, shift + width)}
    free = [b for b in range(64) if b not in used]
    blocks = [free[len(free) * i // n : len(free) * (i + 1) // n] for i in range(n)]
    return [[(b, 1 + next((k for k in range(len(bits) - i) if i + k + 1 == len(bits) or bits[i + k + 1] != b + k + 1), 0)) for i, b in enumerate(bits) if not i or bits[i - 1] != b - 1] for bits in blocks]


def key_of(number: int, parts: list[tuple[int, int]]) -> Column:
    key = F.lit(number).cast("long")
    for shift, width in parts:
        key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", shift).bitwiseAND(F.lit((1 << width) - 1)))
    return key


def sharded(nodes: DataFrame, radius: int, equal: int, hot: int = HOT) -> DataFrame:
    """fp, key: the shards of every fingerprint. Members of a hot shard share some of their other bits' blocks, too."""
    choices = block_keys(equal, radius)
    rows = nodes.select("fp", F.posexplode(F.array(*[key_of(i, parts) for i, parts in enumerate(choices)])).alias("choice", "key"))
    sizes = written(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot))
    if sizes.isEmpty():
        return rows.select("fp", "key")
    split = F.lit(None).cast("array<long>")
    for i, parts in enumerate(choices):
        finer = [F.xxhash64("key", F.lit(j), key_of(0, p)) for j, p in enumerate(other_blocks(parts, radius + 1))]
        split = F.when(F.col("choice") == i, F.array(*finer)).otherwise(split)
    rows = rows.join(sizes, "key", "left")
    return rows.select("fp", F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(split)).alias("key"))


def whole_shards(batches: Iterator[pd.DataFrame], least: int = 50_000) -> Iterator[pd.DataFrame]:
    """Rows sorted by ``key``, regrouped so that no shard is cut; about ``least`` at once."""
    held: list[pd.DataFrame] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        rows += len(b)
        if rows >= least and held[0]["key"].iloc[0] != b["key"].iloc[-1]:  # the last shard may go on
            part = pd.concat(held, ignore_index=True)
            done = part["key"] != part["key"].iloc[-1]
            yield part[done].reset_index(drop=True)
            held, rows = [part[~done].reset_index(drop=True)], int((~done).sum())
    if rows:
        yield pd.concat(held, ignore_index=True)


def links(nodes: DataFrame, radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Spanning links (a, b) of distinct fingerprints ``fp`` within ``radius`` bits, found shard by shard."""
    n, equal = nodes.count(), 1
    while n >> (64 * equal // (radius + equal)) > SHARD and equal < 6:
        equal += 1
    shards = sharded(nodes, radius, equal, hot)
    shards = shards.repartition(partitions(shards), "key").sortWithinPartitions("key", "fp")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def solve(part: pd.DataFrame) -> pd.DataFrame:
            key, fps = part["key"].to_numpy(), part["fp"].to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            root = np.repeat(starts, np.diff(np.r_[starts, len(key)]))
            label = shard_links(fps, root, radius)
            far = label != np.arange(len(label))
            return pd.DataFrame({"a": fps[far].view(np.int64), "b": fps[label[far]].view(np.int64)})

        yield from map(solve, whole_shards(batches))

    return shards.mapInPandas(search, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node reachable, for all nodes of the undirected ``edges`` (a, b).

    Each round takes the least label of a node's neighbours and then its label's label (pointer jumping); rounds are
    logarithmic in the diameter for the stars that shards report. Each round is written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")))
    old = labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = written(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low")))
        up = low.select(F.col("node").alias("low"), F.col("low").alias("up"))
        new = written(low.join(up, "low", "left").select("node", "label", F.least("low", "up").alias("new")))
        moved = new.where("new <> label").limit(1).count()
        discard(old, low)
        old, labels = new, new.select("node", F.col("new").alias("label"))
        if not moved:
            discard(both)
            return labels


def simhash_components(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, hot: int = HOT) -> DataFrame:
    """doc_id, fp, component_id (least doc_id reachable over links of ``radius`` bits or fewer) of every document."""
    tune(docs.sparkSession)
    fps = written(fingerprints(docs, shingle))
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    labels = components(links(nodes.select("fp"), radius, hot))
    member = nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "rep", "n", F.coalesce("label", "fp").alias("label"))
    member = written(member)
    least = written(member.groupBy("label").agg(F.min("rep").alias("component_id")))  # written, so that a hot label's join can be split
    named = written(member.join(least, "label").select("fp", "n", "component_id"))
    discard(nodes, member, least)
    return salted_join(fps, named, "fp", "doc_id", "inner")


def once(docs: DataFrame, least: DataFrame) -> DataFrame:
    """The documents whose doc_id is in ``least``, once each, and all without an id."""
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever the columns are called, none clashes
    id_, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = docs.toDF(*names)
    stay = rows.join(least.select(F.col("doc_id").alias(id_)), id_, "left_semi")
    first = F.row_number().over(Window.partitionBy(id_).orderBy(F.xxhash64(text))).alias("nth")
    kept = stay.select("*", first).where("nth = 1").select(*names)
    return kept.unionByName(rows.where(F.col(id_).isNull())).toDF(*docs.columns)


def one_of_each(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """The document with the least id of each component, once; documents without an id all stay."""
    groups = simhash_components(docs.select("doc_id", "text"), radius, shingle)
    return once(docs, groups.where("doc_id = component_id").select("doc_id").distinct())
