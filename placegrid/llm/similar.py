"""SimHash near-duplicates by similarity: fingerprints compared in shards that suit a Jaccard similarity instead of a radius.

Texts are sets of XXH64 of their 5-word shingles (lower-cased A-Z only; a shorter text is one shingle), with the SimHash
of the set. Documents whose Jaccard similarity is ``LEAST`` (0.8) or more link; groups are the transitive closure. At 0.8
fingerprints differ by 10 of 64 bits on average, and by more than ``RADIUS`` in less than one pair of 100,000. The
pigeonhole shards of ``simhash`` would hold a large part of any corpus at that radius, so here a shard is what shares one
of ``BANDS`` keys of ``ROWS`` MinHash values each. A pair at 0.8 has no common shard in (1 - 0.8^5)^24, less than one
case in 10,000, and more similar ones still less often.

Equal sets collapse first. A shard's head is the root: every member whose fingerprint lies within the radius of the head's is
checked against it, and links are joined. In the shards whose members are still in different groups, all members but those of
the largest group search BK-trees for members of other groups. There is a tree for each shingle of a prefix filter: with the
rarest shingles first, similar sets share one among the first fifth of each, with enough left after it. A tree's nodes are the
distinct fingerprints of the sets that have its shingle there (children keyed by their Hamming distance to the parent), and a
search follows only the edges within the radius. So large groups cost one check a member, members that only resemble such a
group cost few, and no candidate is left out. Checks compare the whole sets.

Texts stay where they are: a bitmap of fixed size tells which of them have candidates, and only their sets move.

Nulls and edges: texts without words are copies of each other; a null doc_id is never dropped and drops nothing; of
repeated rows one stays; any further columns pass through, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegrid.llm.common import mapped, texts, tune, written
from placegrid.llm.simhash import SEED, bk_forest, components, fingerprint, majority, once, tree_hits, whole_shards

SHINGLE, BANDS, ROWS = 5, 24, 5
#: Similarity from which documents link, as a fraction so that the comparison is exact.
LEAST = (4, 5)
#: Bits of the map of documents with candidates; more candidates than that only make sets that are then left out.
SLOTS = 1 << 24
#: Shingles hashed at once.
CHUNK = 4096
#: Bits by which fingerprints of similar sets may differ.
RADIUS = 28
#: Searches in one tree above which they are dealt over several copies of it.
HOT = 20_000
#: Pairs of members that a task looks at together.
AT_ONCE = 1 << 20

_rng = np.random.default_rng(SEED)
TIMES = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def grams(text: bytes | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of one text."""
    return np.unique(fingerprint((text or b"").lower().split(), shingle))


def signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def node(own: np.ndarray) -> int:
    """A set's own hash, signed."""
    return signed(xxhash.xxh64_intdigest(own.tobytes(), SEED))


def band_keys(own: np.ndarray) -> list[int]:
    """One key a band from the set's MinHash values; none of an empty set."""
    if not len(own):
        return []
    low = np.full(BANDS * ROWS, (1 << 64) - 1, np.uint64)
    for at in range(0, len(own), CHUNK):
        low = np.minimum(low, (own[at : at + CHUNK, None] * TIMES + PLUS).min(axis=0))
    return [signed(xxhash.xxh64_intdigest(b.tobytes(), i)) for i, b in enumerate(low.reshape(BANDS, ROWS))]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def near_size(a: str, b: str) -> Column:
    """Whether sets of such sizes can be alike."""
    return LEAST[1] * F.least(a, b).cast("long") >= LEAST[0] * F.greatest(a, b).cast("long")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, node, fp, size and keys of every whole text."""

    def run(c: dict) -> dict:
        sets = [grams(t) for t in c["text"]]
        return {"doc_id": c["doc_id"], "node": [node(s) for s in sets], "fp": [majority(s) for s in sets], "size": [len(s) for s in sets], "keys": [band_keys(s) for s in sets]}

    return mapped(texts(docs), run, "doc_id long, node long, fp long, size int, keys array<long>")


def slot() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS)).cast("int")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, grams of the nodes in ``wanted`` (node, doc_id), each once; of the other texts only few are measured."""
    words = wanted.select(slot().alias("s")).groupBy(F.shiftright("s", 5).alias("word")).agg(F.expr("bit_or(1L << (s & 31))").alias("bits")).toPandas()
    bits = np.zeros(SLOTS >> 5, np.uint32)
    bits[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)

    def run(c: dict) -> dict:
        found = [grams(t) for t, s in zip(c["text"], c["slot"], strict=True) if int(bits[s >> 5]) >> (s & 31) & 1]
        return {"node": [node(s) for s in found], "grams": [s.tobytes() for s in found]}

    made = mapped(texts(docs, slot().alias("slot")), run, "node long, grams binary")
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""

    def run(c: dict) -> dict:
        sets = [[np.frombuffer(x, np.uint64) for x in c[n]] for n in ("grams_a", "grams_b")]
        hit = [alike(a, b) for a, b in zip(*sets, strict=True)]
        return {n: [x for x, h in zip(c[n], hit, strict=True) if h] for n in ("a", "b")}

    both = pairs.select("a", "b")
    for n in ("a", "b"):
        both = both.join(sets.select(F.col("node").alias(n), F.col("grams").alias(f"grams_{n}")), n)
    return mapped(both, run, "a long, b long")


def prefixes(members: DataFrame, sets: DataFrame) -> DataFrame:
    """``members`` (node, size, ...), once for each gram of its prefix that another member has too, with its place ``at`` (from 1).

    With the rarest grams first, sets of ``LEAST`` similarity share one of the first ``size - ceil(LEAST * size) + 1`` of
    each. Grams that only one member has take places there but are not returned.
    """

    def run(c: dict) -> dict:
        return {"node": c["node"], "own": [np.frombuffer(x, np.int64) for x in c["grams"]]}

    own = mapped(sets.join(members.select("node"), "node", "left_semi"), run, "node long, own array<long>").select("node", F.explode("own").alias("gram"))
    shared = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    left = own.join(shared, "gram").join(members, "node")
    node, least = Window.partitionBy("node"), F.ceil(F.col("size").cast("long") * LEAST[0] / LEAST[1])
    left = left.withColumn("at", F.col("size") - F.count(F.lit(1)).over(node) + F.row_number().over(node.orderBy("n", "gram")))
    return left.where(F.col("at") <= F.col("size") - least + 1).drop("n")


def within(a: str, b: str) -> Column:
    """Whether fingerprints lie within the radius."""
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS


def tree_pairs(shards: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (row that asks, row) of different labels that can be alike, found in the BK-trees of whole shards.

    ``shards``: key, fp, label, size, at, asks, in order of key and fp.
    """
    key, fp, label, size, at, asks = (shards[n].to_numpy() for n in ("key", "fp", "label", "size", "at", "asks"))
    size = size.astype(np.int64)
    begin = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (fp[1:] != fp[:-1])])  # of each tree node's rows
    count, n_asks = np.diff(np.r_[begin, len(key)]), np.add.reduceat(asks.astype(np.int64), begin)
    tops = np.flatnonzero(np.r_[True, key[begin][1:] != key[begin][:-1]])
    root = np.repeat(tops, np.diff(np.r_[tops, len(begin)]))
    asking, first = np.flatnonzero(asks), np.cumsum(n_asks) - n_asks
    nodes, q = fp[begin].view(np.uint64), np.flatnonzero(n_asks)
    for one, other in tree_hits(nodes, bk_forest(nodes, root), q, root[q], RADIUS):
        stop = np.cumsum(n_asks[one] * count[other])
        lo = 0
        while lo < len(one):
            hi = max(lo + 1, int(np.searchsorted(stop, (stop[lo - 1] if lo else 0) + AT_ONCE, side="right")))
            x, y = one[lo:hi], other[lo:hi]
            n = n_asks[x] * count[y]
            i, k = np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            a, b = asking[first[x][i] + k // count[y][i]], begin[y][i] + k % count[y][i]
            fits = (label[a] != label[b]) & (LEAST[1] * np.minimum(size[a], size[b]) >= LEAST[0] * np.maximum(size[a], size[b]))
            # of two alike sets, from the first shared gram on each has as many grams left as must be shared; LEAST / (1 + LEAST) of both sizes
            fits &= (1 + np.minimum(size[a] - at[a], size[b] - at[b])) * sum(LEAST) >= (size[a] + size[b]) * LEAST[0]
            yield a[fits], b[fits]
            lo = hi


def across(left: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of different labels that can be alike, once; any that share a key in ``left`` (key, node, fp, size, label) are among them."""
    top = left.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.max(F.struct("n", "label")).alias("top"), F.count(F.lit(1)).alias("labels"))
    rows = left.join(written(top.where("labels > 1").select("key", F.col("top.label").alias("top"))), "key")
    members = rows.groupBy("node", "label", "fp", "size").agg(F.max(F.col("label") != F.col("top")).alias("asks"))
    found = written(prefixes(written(members), sets))
    asked = found.groupBy("gram").agg(F.sum(F.col("asks").cast("long")).alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    shards = found.join(asked.where("n > 0 and low <> high").select("gram", F.ceil(F.col("n") / HOT).alias("copies")), "gram")
    shards = shards.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    turn = F.col("asks") & (F.pmod(F.xxhash64("node"), "copies") == F.col("copy"))
    shards = shards.select(F.xxhash64("gram", "copy").alias("key"), "node", "fp", "label", "size", "at", turn.alias("asks"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in whole_shards(batches):
            node = part["node"].to_numpy()
            for a, b in tree_pairs(part):
                yield pd.DataFrame({"a": np.minimum(node[a], node[b]), "b": np.maximum(node[a], node[b])})

    return shards.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(search, "a long, b long").distinct()


def labelled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``nodes`` with the label of their group."""
    return nodes.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))


def groups(docs: DataFrame) -> DataFrame:
    """node, rep (its least doc_id) and label (equal within a group) of every distinct set."""
    rows = signatures(docs)
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    shards = nodes.select("node", "rep", "fp", "size", F.explode("keys").alias("key"))
    heads = shards.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("rep", "node", "size", "fp")).alias("head"))
    shards = written(shards.join(written(heads.where("n > 1").drop("n")), "key"))  # written, so that a hot shard's join can be split
    wanted = written(shards.select("node", F.col("rep").alias("doc_id")).distinct())
    sets = written(sets_of(docs, wanted))
    stars = shards.where("node <> head.node").withColumn("other", F.col("head.size")).where(near_size("size", "other") & within("fp", "head.fp"))
    edges = written(checked(stars.select(F.col("head.node").alias("a"), F.col("node").alias("b")).distinct(), sets))
    left = written(labelled(shards.where("node <> head.node").select("key", "node", "fp", "size"), edges))
    more = written(checked(written(across(left, sets)), sets))
    return labelled(nodes.select("node", "rep"), edges.unionByName(more))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The document with the least id of each group, once; documents without an id all stay."""
    tune(docs.sparkSession)
    found = groups(docs.where("doc_id is not null").select("doc_id", "text"))
    return once(docs, found.groupBy("label").agg(F.min("rep").alias("doc_id")).select("doc_id").distinct())
