"""Spelling variants through a dictionary of trie-node pairs.

Two words are near if they differ by exactly one inserted, deleted or replaced code point. The words are put into a trie,
and backwards into a second one, and the nodes of both are numbered. A word then gives pairs of integers (node of the
first i code points, node of the last ones): with one position skipped in between, as a *member*, and with none skipped,
as a *centre*. Words of one pair are what a neighbour can be, exactly: two members of a pair differ in the skipped
position alone, and the one centre that a pair can have is each member without that position. A member counts for the
centre only at the first of a stretch of equal letters, so every two words meet in one pair. A pair has at most as many
members as the alphabet has letters (90 here), so its rows are summed as one small list; nothing is joined with itself.

Numbering: words are sorted in ranges; a word adds a node for each code point beyond what it shares with the word before.
Each range numbers its own nodes; a row a range (first and last word, the path of the last) goes to the driver, which
carries paths and totals from range to range. Only nodes that at least two words pass through can match, so a word gives
pairs of such nodes only.

A word's *form* is its near word of largest count (of equal ones the least in code-point order) if that is ``TIMES`` its
own or more, and its *root* the end of the chain of forms. Counts grow tenfold along it, so chains are short and halved by
joins.

Nulls and edges: a null or empty text has no words; an empty table, or one without words that occur ``OCCURRENCES``
times, gives no rows; repeated rows count; a null doc_id counts like any other; bytes that are no UTF-8 end a word; extra
columns are ignored. A letter run is held whole by a task.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegrid.llm.common import discard, partitions, texts, tune, written

#: Code points of a word at least, and its occurrences.
LETTERS, OCCURRENCES = 7, 2
#: A form occurs so many times as often at least.
TIMES = 10
#: Distinct words that a task counts before it hands them on.
HELD = 200_000

Edit = Callable[[int | None, str], str]


def counted(docs: DataFrame, edit: Edit | None = None, letters: int = LETTERS, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n: the runs of Latin letters (A-Z lower-cased) with ``letters`` code points or more, and how often they occur.

    ``edit``: what a run of a document becomes before it is counted. Each task adds up what it has before a shuffle.
    """
    tune(docs.sparkSession)
    find = re.compile(f"[a-zÀ-ÿ]{{{letters},}}").findall

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = Counter(find((text or b"").lower().decode("utf-8", "replace")))
                if edit:
                    for word, n in found.items():
                        if len(new := edit(doc, word)) >= letters:
                            held[new] += n
                else:
                    held.update(found)
            if len(held) > HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    return texts(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= occurrences)


def shared(a: str, b: str) -> int:
    return len(commonprefix((a, b)))


def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str]]]:
    """The keys of each range; rows come sorted by range and key."""
    now, held = -1, []
    for b in batches:
        for part, key in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if part != now:
                if held:
                    yield now, held
                now, held = part, []
            held.append(key)
    if held:
        yield now, held


def paths(keys: list[str]) -> Iterator[list[int]]:
    """The numbers of each key's nodes, from 1 in the order in which sorted keys make them; the root (0) first."""
    path, last, total = [0], "", 0
    for key in keys:
        keep = shared(last, key)
        path = path[: keep + 1] + list(range(total + 1, total + len(key) - keep + 1))
        total += len(key) - keep
        last = key
        yield path


def numbered(words: DataFrame, key: Column) -> DataFrame:
    """key, nodes (of its first 0, 1, ... code points) and most: how many of them it shares with any other key.

    Keys are distinct.
    """
    n = partitions(words, 4 << 20)
    ranges = words.select(key.alias("key")).repartitionByRange(n, "key").sortWithinPartitions("key")
    kept = written(ranges.select(F.spark_partition_id().alias("part"), "key"))
    dealt = kept.repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).sortWithinPartitions("part", "key")

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys in by_range(batches):
            total = 0
            for path in paths(keys):
                total = max(total, path[-1])
            row = ([part], [total], [keys[0]], [keys[-1]], [path])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())), strict=True)], names=["part", "total", "first", "last", "path"])

    carried: dict[int, tuple[list[int], int, str, str]] = {}  # by range: nodes carried in, number before its own, neighbours
    before, path, base = "", [0], 0
    rows = sorted(dealt.mapInArrow(ends, "part int, total long, first string, last string, path array<long>").collect())  # a row a range
    for i, r in enumerate(rows):
        same = shared(before, r.first)
        came, down = path[: same + 1], base - same  # own node x > same becomes down + x
        carried[r.part] = came, down, before, rows[i + 1].first if i + 1 < len(rows) else ""
        path = [came[x] if x <= same else down + x for x in r.path]
        before, base = r.last, down + r.total

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keys in by_range(batches):
            came, down, before, after = carried[part]
            low, both, out = np.array(came, np.int64), [before, *keys, after], ([], [], [])

            def rows() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.list_(pa.int64()), pa.int32()), strict=True)], names=["key", "nodes", "most"])

            for i, own in enumerate(paths(keys)):
                nodes = np.array(own, np.int64)
                out[0].append(keys[i])
                out[1].append(np.where(nodes < len(low), low[np.minimum(nodes, len(low) - 1)], down + nodes))
                out[2].append(max(shared(both[i], keys[i]), shared(keys[i], both[i + 2])))
                if len(out[0]) == 10_000:
                    yield rows()
                    out = ([], [], [])
            if out[0]:
                yield rows()

    return dealt.mapInArrow(name, "key string, nodes array<long>, most int")


def near(words: DataFrame) -> DataFrame:
    """word, n_near, best: how many words are near, and the one of largest count as struct(less = -n, word); words: word, n."""
    forward = numbered(words, F.col("word")).select(F.col("key").alias("word"), F.col("nodes").alias("a"), F.col("most").alias("first"))
    backward = numbered(words, F.reverse("word")).select(F.reverse("key").alias("word"), F.col("nodes").alias("b"), F.col("most").alias("last"))
    both = words.join(forward, "word").join(backward, "word").withColumn("size", F.length("word"))
    i, size = F.col("i"), F.col("size")

    def spread(skip: int) -> DataFrame:
        low, high = F.greatest(F.lit(0), size - skip - F.col("last")), F.least(size - skip, F.col("first"))
        rows = both.select("*", F.explode(F.when(low <= high, F.sequence(low, high))).alias("i"))
        starts = (i == 0) | (F.substring("word", i, F.lit(1)) != F.substring("word", i + 1, F.lit(1)))  # a stretch of equal letters
        return rows.select(F.get("a", i).alias("p"), F.get("b", size - skip - i).alias("s"), F.struct((-F.col("n")).alias("less"), "word", F.lit(skip == 1).alias("member"), (starts if skip else F.lit(False)).alias("starts")).alias("x"))

    pairs = spread(1).unionByName(spread(0)).groupBy("p", "s").agg(F.collect_list("x").alias("all")).where(F.size("all") > 1)  # at most alphabet + 1 rows

    def met(x: Column, y: Column) -> Column:
        return (y["word"] != x["word"]) & F.when(x["member"], y["member"] | x["starts"]).otherwise(y["member"] & y["starts"])

    others = pairs.select(F.explode("all").alias("x"), "all").select(F.col("x.word").alias("word"), F.filter("all", lambda y: met(F.col("x"), y)).alias("near"))
    some = others.where(F.size("near") > 0).select("word", F.size("near").alias("n"), F.array_min(F.transform("near", lambda y: F.struct(y["less"].alias("less"), y["word"].alias("word")))).alias("best"))
    return some.groupBy("word").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, longest: int) -> DataFrame:
    """word, root for rows (word, form): forms followed to the last; chains have ``longest`` links at most."""
    links = written(forms.select("word", F.col("form").alias("root")))
    for _ in range(math.ceil(math.log2(max(longest, 1)))):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        before, links = links, written(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        discard(before)
    return links


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct words (word, n); form and form_n are null where there is none."""
    words = written(words)
    most = words.agg(F.max("n")).first()[0] or 1
    found = written(words.join(near(words), "word", "left"))
    fits = -F.col("best.less") >= times * F.col("n")
    rows = found.select("word", F.when(fits, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, -F.col("best.less")).alias("form_n"))
    ends = roots(rows.where("form is not null"), int(math.log(most, times)) + 1)
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
