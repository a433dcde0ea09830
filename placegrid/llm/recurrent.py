"""Documents scored by a gated recurrent language model with a class-factored output.

Tokens are the words of a text (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and one end. The counts of all tokens of all
training documents (CRC-32 of the id as text, modulo ``FOLDS``, is not ``HELD_OUT``) are made by shuffles and grow with the corpus; every word
of every document is looked up in them. They give the base score (smoothed single tokens), and the model's output rests
on them:

* the ``WORDS`` most frequent tokens are cut into ``CLASSES`` classes of about equal sums of root counts; a softmax over
  the classes times one within the class (each token a vector and a bias) is the probability of a token;
* all others, seen or not, fall into ``ENDINGS`` further classes by their last two bytes (the most frequent ones, and the
  rest); within such a class a token has its smoothed share (c + 0.5) / (C + 0.5 (V + 1)) of the class's C tokens of V kinds.

Biases start at the logarithms of the counts, so before training the model is the base one; training adds what the state
tells. The network learns from every training document, whole. Every task goes on from the common network with the
documents of its chunks: truncated backpropagation in numpy over streams of documents in windows of ``WINDOW`` tokens, whose
states pass on to the next window, steps by AdaGrad. Then the tasks' networks, with their sums of squared gradients, are
averaged (by tokens learned from) block by block in a shuffle. This is done ``ROUNDS`` times, each with another share of each
chunk's documents, so that together they are one pass over all; every corpus, of whatever size, is gone over ``PASSES`` times. The driver holds one averaged network, which is of a fixed size. Which documents a task has depends on how
files are dealt out, so scores may differ a little between clusters. Scoring goes through whole documents side by side,
window by window, and carries every document's state across.

Texts are split once: chunks of documents are written as a bucketed table of distinct words, with their training counts, and
of places among them. Each chunk sends these words and gets back the counts of those that are not among the most frequent; the
latter travel with the tasks (a fixed number). With the counts, places become token numbers of two bytes, which learning and
scoring read.

Nulls and edges: a null or empty text is the end token alone; a null doc_id is scored, never learned from, and its
held_out is null; repeated rows count and score each; without training documents all counts are 0, the base score is 0
and the model is uniform over its classes; extra columns are ignored; an empty table gives no rows. A task holds a
document whole.
"""

from __future__ import annotations

import copy
import sys
import zlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placegrid.llm.common import discard, partitions, table_name, texts, trim, tune, written
from placegrid.llm.exchange import HOME, buckets

FOLDS, HELD_OUT = 5, 1
#: The end of a document; no word holds white space.
END = b"\n"
WORDS, CLASSES, ENDINGS = 3072, 40, 24
HIDDEN = 16
#: Averagings in a pass over the training documents, and passes.
ROUNDS, PASSES = 4, 2
#: Documents that are read side by side, at most; fewer, so that a stream has some ``WINDOWS`` windows.
STREAMS, WINDOW, WINDOWS = 128, 24, 20
RATE = 0.2
#: Bytes of text in a chunk: the larger, the fewer words are sent.
CHUNK = 4 << 20
#: Tokens that are held to be learned from or to be scored, and documents that are scored side by side.
AT_ONCE, TOGETHER, ABREAST = 1 << 20, 1 << 22, 512
#: Numbers of a network that are averaged in one row.
AVERAGED = 1 << 14
#: Rows of an output's block, which should stay in a processor's cache.
BLOCK = 1 << 11
#: Rows of a run that are summed side by side with those of others.
SHORT = 8


def held_out(doc: int | None) -> bool:
    """Whether nothing is learned from the document."""
    return doc is None or zlib.crc32(b"%d" % doc) % FOLDS == HELD_OUT


class Vocabulary(NamedTuple):
    """Statistics of the training tokens, of a fixed size."""

    words: list[bytes]  # the most frequent, END first
    counts: np.ndarray
    start: np.ndarray  # of each class among the words, and their number at the end
    endings: dict[bytes, int]
    sums: np.ndarray  # tokens of each ending's class
    kinds: np.ndarray
    tokens: int
    distinct: int


def tokens_of(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words in the order of their first occurrence, all words as their numbers, and each text's number of words."""
    words = [t.lower().split() for t in texts]
    coded = pa.array(chain.from_iterable(words), pa.binary()).dictionary_encode()  # faster than a dict of bytes
    return coded.dictionary, coded.indices.to_numpy(), np.array([len(w) for w in words], np.int64)


CHUNK_SCHEMA = "home long, part long, ids array<bigint>, sizes array<int>, tokens binary, words array<binary>, times array<bigint>"


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which compresses better."""
    whole = numbers.astype("<u4").view(np.uint8)
    return b"".join(whole[i::4].tobytes() for i in range(4))


def from_planes(data: bytes) -> np.ndarray:
    whole = np.empty(len(data), np.uint8)
    for i, plane in enumerate(np.frombuffer(data, np.uint8).reshape(4, -1)):
        whole[i::4] = plane
    return whole.view("<u4")


def tokenized(docs: DataFrame) -> DataFrame:
    """Documents (null text: empty) in rows of about ``CHUNK`` bytes of text, as a table bucketed by ``home``.

    Of a chunk: its documents' ids and numbers of words; all words, each as its place among the distinct ``words``, of which END is the
    last; and how often those occur in its documents that are learned from. So texts are split once and not stored.
    """
    spark = docs.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ids, held, total = TaskContext.get().partitionId() << 24, [], [], 0

        def row() -> pa.RecordBatch:
            words, token, sizes = tokens_of(held)
            learned = np.array([not held_out(d) for d in ids])
            times = np.bincount(token[np.repeat(learned, sizes)], minlength=len(words))
            words = pa.concat_arrays([words, pa.array([END], pa.binary())])
            columns = ([part >> HOME], [part], [ids], [sizes], [planes(token)], pa.ListArray.from_arrays([0, len(words)], words), [np.r_[times, learned.sum()]])
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in CHUNK_SCHEMA.split(", ")])

        for b in batches:
            for doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if ids and total + len(text or b"") > CHUNK:
                    yield row()
                    part, ids, held, total = part + 1, [], [], 0
                    trim()
                ids.append(doc)
                held.append(text or b"")
                total += len(held[-1])
        if ids:
            yield row()

    name, path = table_name(spark)
    rows = texts(docs).mapInArrow(pack, CHUNK_SCHEMA)
    rows.write.bucketBy(buckets(partitions(docs, 8 << 20)), "home").option("compression", "zstd").option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._scratch = path
    return out


def vocabulary(counts: DataFrame, size: int = WORDS, classes: int = CLASSES, endings: int = ENDINGS) -> tuple[Vocabulary, DataFrame]:
    """The statistics of all words (word, n: a written table), and the rows of those that are not among the most frequent."""
    spark = counts.sparkSession
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("kinds")).first()
    ends = counts.where(F.col("word") == F.lit(END)).first()
    top = [r for r in counts.orderBy(F.desc("n"), "word").limit(size).collect() if bytes(r["word"]) != END][: size - 1]
    words, n = [END, *(bytes(r["word"]) for r in top)], np.array([ends["n"] if ends else 0, *(r["n"] for r in top)], np.float64)
    root = np.sqrt(n + 0.5)
    of = np.minimum((np.cumsum(root) - root) / root.sum() * classes, classes - 1).astype(int)
    start = np.searchsorted(of, np.unique(of)).tolist()
    rest = counts.join(F.broadcast(spark.createDataFrame(pa.table({"word": pa.array(words, pa.binary())}))), "word", "left_anti")  # a fixed number
    by_end = rest.groupBy(F.substring("word", -2, 2).alias("ending")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).orderBy(F.desc("n"), "ending").limit(endings - 1).collect()
    sums, kinds = [r["n"] for r in by_end], [r["kinds"] for r in by_end]
    sums.append(total["n"] - int(n.sum()) - sum(sums))
    kinds.append(total["kinds"] - int((n > 0).sum()) - sum(kinds))
    found = {bytes(r["ending"]): i for i, r in enumerate(by_end)}
    return Vocabulary(words, n, np.array([*start, len(words)]), found, np.array(sums, np.float64), np.array(kinds, np.float64), total["n"], total["kinds"]), rest


def sigmoid(x: np.ndarray) -> np.ndarray:
    """Overwrites ``x``."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def limited(gradient: np.ndarray) -> np.ndarray:
    """The gradient at a length of 1 at most, against bursts."""
    return gradient / max(1.0, float(np.sqrt((gradient * gradient).sum())))


def moved_down(a: np.ndarray, wide: bool) -> np.ndarray:
    """``a``, its rows moved if they may go beyond the range of 32-bit numbers; a softmax stays the same."""
    if wide:
        a -= a.max(1, keepdims=True)
    return a


def powers(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Exponentials, which overwrite ``a``, and each row's sum."""
    np.exp(a, out=a)
    return a, a @ np.ones(a.shape[1], a.dtype)  # a product is faster than sums of short rows


def chosen(a: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Logarithm of the softmax of each row of ``a`` at one place; overwrites ``a``."""
    own = a[np.arange(len(a)), at]
    return own - np.log(powers(a)[1])


def sums_of_runs(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the runs of rows that begin at ``first``: long runs by a product each, short ones side by side."""
    size = np.diff(first, append=len(rows))
    order = np.argsort(-size, kind="stable")
    least, begin = -size[order], first[order]
    out, long = np.take(rows, begin, axis=0), int(np.searchsorted(least, -SHORT))
    for i, (lo, n) in enumerate(zip(begin[:long].tolist(), (-least[:long]).tolist(), strict=True)):
        out[i] = np.ones(n, rows.dtype) @ rows[lo : lo + n]
    for more in range(1, SHORT):
        stop = int(np.searchsorted(least, -more))
        if stop == long:
            break
        out[long:stop] += np.take(rows, begin[long:stop] + more, axis=0)
    back = np.empty_like(out)
    back[order] = out
    return back


class Network:
    """A gated recurrent unit over token numbers (words, then endings) with a class-factored softmax."""

    def __init__(self, v: Vocabulary, hidden: int = HIDDEN, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.hidden, self.start, m = hidden, v.start, len(v.words)
        self.of = np.concatenate([np.repeat(np.arange(len(v.start) - 1), np.diff(v.start)), len(v.start) - 1 + np.arange(len(v.sums))]).astype(np.int16)  # class of a token; small numbers are sorted by digits
        mass = np.add.reduceat(v.counts, v.start[:-1])
        small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
        self.gates = {"input": small(m + len(v.sums), 3 * hidden), "state": small(hidden, 3 * hidden) * 2, "shift": np.zeros(3 * hidden, np.float32)}
        self.gates["shift"][:hidden] = 1  # states are kept at first
        self.out = {"class": small(len(mass) + len(v.sums), hidden), "class_bias": np.log(np.r_[mass, v.sums] + 0.5).astype(np.float32), "word": small(m, hidden), "word_bias": np.log(v.counts + 0.5).astype(np.float32)}
        self.seen = {k: np.full_like(p, 1e-3) for k, p in (self.gates | self.out).items()}  # sums of squared gradients

    def tables(self) -> list[np.ndarray]:
        """All that learning moves."""
        return [*self.gates.values(), *self.out.values(), *self.seen.values()]

    def vector(self) -> np.ndarray:
        return np.concatenate([t.ravel() for t in self.tables()])

    def take(self, vector: np.ndarray) -> None:
        """The reverse of ``vector``."""
        at = 0
        for t in self.tables():
            t[...] = vector[at : at + t.size].reshape(t.shape)
            at += t.size

    def step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """New state, and what the way back needs, for gate inputs ``x`` and states ``h``.

        All are rows that lie column by column in memory, so that each gate is one stretch of it; others are only slower.
        """
        k, x, h = self.hidden, x.T, h.T
        u = self.gates["state"].T @ h
        g = sigmoid(x[: 2 * k] + u[: 2 * k])
        z, r, u = g[:k], g[k:], u[2 * k :]
        c = r * u
        c += x[2 * k :]
        c *= 2  # a hyperbolic tangent by the exponential, which is faster
        c = sigmoid(c)
        c *= 2
        c -= 1
        new = h - c
        new *= z
        new += c
        return new.T, z.T, r.T, c.T, u.T

    def biased(self, name: str) -> np.ndarray:
        """An output table with its biases as a last column."""
        p = self.out[name]
        out = np.empty((len(p), self.hidden + 1), p.dtype)
        out[:, :-1], out[:, -1] = p, self.out[f"{name}_bias"]
        return out

    def by_class(self, h: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, ...]:
        """Order of the tokens by class; in it the states with a 1 for the bias, the tokens and their classes; where each class of words begins."""
        of = self.of[token]
        order = np.argsort(of, kind="stable")
        rows = np.empty((len(token), self.hidden + 1), h.dtype)
        rows[:, :-1], rows[:, -1] = np.take(h, order, axis=0), 1
        of = of[order]
        return order, rows, token[order], of, np.searchsorted(of, np.arange(len(self.start), dtype=of.dtype))

    def wide(self, table: np.ndarray, start: np.ndarray) -> list[bool]:
        """For each class that begins at ``start``, whether some output may leave the range of 32-bit numbers; states are within -1 and 1."""
        return (np.maximum.reduceat(np.abs(table).sum(1), start) > 60).tolist()

    def log_likelihood(self, h: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Natural logarithms of the tokens' probabilities (of an ending: its class's) given the states before them."""
        order, rows, want, of, first = self.by_class(h, token)
        classes, words, out = self.biased("class"), self.biased("word"), np.empty(len(token), np.float64)
        (wide,) = self.wide(classes, np.zeros(1, np.int64))
        for lo in range(0, len(token), BLOCK):
            out[lo : lo + BLOCK] = chosen(moved_down(rows[lo : lo + BLOCK] @ classes.T, wide), of[lo : lo + BLOCK])
        start, first = self.start.tolist(), first.tolist()
        for c, wide in enumerate(self.wide(words, self.start[:-1])):
            if start[c + 1] - start[c] > 1:
                own = words[start[c] : start[c + 1]].T
                for lo in range(first[c], first[c + 1], BLOCK):
                    some = slice(lo, min(lo + BLOCK, first[c + 1]))
                    out[some] += chosen(moved_down(rows[some] @ own, wide), want[some] - start[c])
        back = np.empty_like(out)
        back[order] = out
        return back

    def moved(self, name: str, gradient: np.ndarray, rows: np.ndarray | None = None) -> None:
        """A step by AdaGrad; of a table only the given distinct rows move."""
        p, seen = (self.gates if name in self.gates else self.out)[name], self.seen[name]
        s = gradient * gradient
        if rows is None:
            seen += s
            np.sqrt(seen, out=s)
        else:
            s += np.take(seen, rows, axis=0)
            seen[rows] = s
            np.sqrt(s, out=s)
        np.divide(gradient, s, out=s)
        s *= RATE
        if rows is None:
            p -= s
        else:
            p[rows] -= s

    def learn(self, before: np.ndarray, token: np.ndarray, fresh: np.ndarray, h: np.ndarray, streams: int = 0) -> np.ndarray:
        """One window (window x streams) of truncated backpropagation; ``fresh`` marks a document's first token.

        ``streams``: how many there are, if these are only some. Returns the streams' last states. Only what a step needs of the one before is done step by step, on tables that lie
        column by column; the rest is done for the whole window.
        """
        k, (steps, n) = self.hidden, token.shape
        streams = streams or n
        news = [np.flatnonzero(f) for f in fresh]
        x = np.take(self.gates["input"], before.ravel(), axis=0).reshape(steps, n, 3 * k)
        x = np.add(x.transpose(0, 2, 1), self.gates["shift"][:, None], order="C")
        held, h = [], h.T.copy()
        for t in range(steps):
            if len(news[t]):
                h[:, news[t]] = 0
            new, *kept = (a.T for a in self.step(x[t].T, h.T))
            held.append((h, *kept, new))
            h = new if t + 1 == steps or not len(news[t + 1]) else new.copy()
        h0, z, r, c, u, states = (np.stack(a) for a in zip(*held, strict=True))
        back, grads = self.output_gradients(states.transpose(0, 2, 1).reshape(-1, k), token.ravel())
        back = np.ascontiguousarray((back / streams).reshape(steps, n, k).transpose(0, 2, 1))
        kept, slope, factor = 1 - z, 1 - c * c, np.empty((steps, 3, k, n), back.dtype)
        slope *= kept
        kept *= z
        np.multiply(h0 - c, kept, out=factor[:, 0])
        np.multiply(slope, r, out=factor[:, 2])
        u *= factor[:, 2]
        np.multiply(u, 1 - r, out=factor[:, 1])
        du, state, later = np.empty_like(factor), self.gates["state"], np.zeros((k, n), back.dtype)
        for t in range(steps - 1, -1, -1):
            dh = back[t]
            dh += later
            np.multiply(dh, factor[t], out=du[t])
            later = state @ du[t].reshape(3 * k, n)
            later += dh * z[t]
            if len(news[t]):
                later[:, news[t]] = 0
        dstate = np.matmul(h0, du.reshape(steps, 3 * k, n).transpose(0, 2, 1)).sum(0)
        np.multiply(back, slope, out=du[:, 2])
        dx = du.reshape(steps, 3 * k, n).transpose(0, 2, 1).reshape(-1, 3 * k)
        ids = before.ravel()
        order = np.argsort(ids.astype(np.int16 if len(self.of) < 1 << 15 else ids.dtype), kind="stable")  # small numbers are sorted by digits
        ids = ids[order]
        first = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        self.moved("input", sums_of_runs(np.take(dx, order, axis=0), first), ids[first])
        self.moved("state", limited(dstate))
        self.moved("shift", limited(np.ones(len(dx), dx.dtype) @ dx))
        for name, g in grads.items():
            self.moved(name, g[:, :-1] / streams)  # words of classes that do not occur have no gradient and stay
            self.moved(f"{name}_bias", g[:, -1] / streams)
        return h.T

    def output_gradients(self, h: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Gradients, summed over the tokens, for the states and for the output's tables (with biases as last columns)."""
        k = self.hidden
        order, rows, want, of, first = self.by_class(h, token)
        classes, words = self.biased("class"), self.biased("word")
        (wide,) = self.wide(classes, np.zeros(1, np.int64))
        out, grads = np.empty((len(rows), k), rows.dtype), {"class": np.zeros_like(classes), "word": np.zeros_like(words)}
        for lo in range(0, len(rows), BLOCK):
            some = slice(lo, min(lo + BLOCK, len(rows)))
            p, total = powers(moved_down(rows[some] @ classes.T, wide))
            p[np.arange(len(p)), of[some]] -= total  # the gradient, but for a division by the sum
            total = np.reciprocal(total)[:, None]
            np.multiply((p @ classes)[:, :k], total, out=out[some])
            grads["class"] += p.T @ (rows[some] * total)
        # outputs of all classes of words lie one after the other, so that most is done for all at once
        width, size = np.diff(self.start), np.diff(first)
        own = [(c, slice(*x), slice(*y)) for c, (x, y) in enumerate(zip(zip(first[:-1].tolist(), first[1:].tolist(), strict=True), zip(self.start[:-1].tolist(), self.start[1:].tolist(), strict=True), strict=True)) if x[1] > x[0]]
        if own:
            widths = np.repeat(width, size)  # of each row
            begin = np.cumsum(widths) - widths
            flat, wide, n = np.empty(int(widths.sum()), rows.dtype), self.wide(words, self.start[:-1]), len(widths)
            views = np.split(flat, (np.cumsum(width * size)[:-1]).tolist())
            views = [views[c].reshape(-1, words_.stop - words_.start) for c, _, words_ in own]
            for view, (c, some, words_) in zip(views, own, strict=True):
                np.matmul(rows[some], words[words_].T, out=view)
                moved_down(view, wide[c])
            np.exp(flat, out=flat)
            total = np.add.reduceat(flat, begin)
            flat[begin + want[:n] - np.repeat(self.start[:-1], size)] -= total
            total = np.reciprocal(total)[:, None]
            scaled, back = rows[:n] * total, np.empty_like(rows[:n])
            for view, (_, some, words_) in zip(views, own, strict=True):
                np.matmul(view, words[words_], out=back[some])
                np.matmul(view.T, scaled[some], out=grads["word"][words_])
            out[:n] += back[:, :k] * total
        back = np.empty_like(out)
        back[order] = out
        return back, grads

    def train(self, docs: list[np.ndarray], passes: int = 1, streams: int = STREAMS, window: int = WINDOW, seed: int = 2) -> None:
        """``docs``: token numbers without the end; they are dealt over streams, which are read side by side. The first may have one token more."""
        rng = np.random.default_rng(seed)
        for _ in range(passes if docs else 0):
            shuffled = [np.r_[docs[i], 0] for i in rng.permutation(len(docs))]  # END is token 0
            token = np.concatenate(shuffled)
            first = np.zeros(len(token), bool)
            first[np.cumsum([0, *map(len, shuffled[:-1])])] = True
            before = np.where(first, 0, np.r_[0, token[:-1]])
            n = max(1, min(streams, len(token) // (window * WINDOWS)))
            size, more = divmod(len(token), n)
            start = np.arange(n) * size + np.minimum(np.arange(n), more)
            h = np.zeros((n, self.hidden), np.float32)
            for lo in range(0, size, window):
                at = start + np.arange(lo, min(lo + window, size))[:, None]
                h = self.learn(before[at], token[at], first[at], h)
            if more:
                at = start[None, :more] + size
                self.learn(before[at], token[at], first[at], h[:more], n)

    def scored(self, docs: list[np.ndarray], window: int = WINDOW, abreast: int = ABREAST) -> np.ndarray:
        """Natural log-likelihoods of whole documents (token numbers without the end), ends included; states carry across windows.

        Documents of like length go side by side, so few places of a group are idle and its states stay in the cache.
        """
        order, out = np.argsort([-len(d) for d in docs], kind="stable"), np.empty(len(docs))
        for lo in range(0, len(docs), abreast):
            own = order[lo : lo + abreast]
            out[own] = self.scored_group([docs[i] for i in own], window)
        return out

    def scored_group(self, docs: list[np.ndarray], window: int) -> np.ndarray:
        """The same for documents in descending order of length."""
        long = np.array([len(d) + 1 for d in docs])
        flat = np.concatenate([x for d in docs for x in (d, np.zeros(1, np.int32))]).astype(np.int64)  # END is token 0
        first, out = np.cumsum(long) - long, np.zeros(len(docs))
        gates = self.gates["input"] + self.gates["shift"]
        h = np.zeros((self.hidden, len(docs)), np.float32)
        for lo in range(0, int(long[0]), window):
            alive = np.searchsorted(-long, -np.arange(lo, min(lo + window, long[0])), side="left")  # documents with a token there, step by step
            n = int(alive[0])
            states = np.empty((int(alive.sum()), self.hidden), np.float32)
            token, of, done = np.empty(len(states), np.int64), np.empty(len(states), np.int64), 0
            for t, m in enumerate(alive.tolist()):
                at = first[:m] + (lo + t)
                x = np.take(gates, flat[at - 1] if lo + t else np.zeros(m, np.int64), axis=0)
                h = self.step(x, h[:, :m].T)[0].T
                states[done : done + m] = h.T
                token[done : done + m], of[done : done + m] = flat[at], np.arange(m)
                done += m
            out[:n] += np.bincount(of, self.log_likelihood(states, token), n)
        return out


class Read(NamedTuple):
    """A chunk's documents as the model reads them."""

    ids: list[int | None]
    known: list[int]
    base: list[float]
    share: list[float]
    docs: list[np.ndarray]


READ_SCHEMA = "ids array<bigint>, known array<bigint>, base array<double>, share array<double>, sizes array<int>, tokens binary"


def read(batches: Iterator[pa.RecordBatch]) -> Iterator[Read]:
    for b in batches:
        for i in range(b.num_rows):
            c = {n: b.column(j)[i].as_py() for j, n in enumerate(b.schema.names)}
            token = np.frombuffer(c["tokens"], "<u2").astype(np.int32)
            yield Read(c["ids"], c["known"], c["base"], c["share"], np.split(token, np.cumsum(c["sizes"])[:-1]))


def numbered(chunks: DataFrame, v: Vocabulary) -> DataFrame:
    """Chunks with the training counts ``n`` of their words ``at`` as rows of ``READ_SCHEMA``: the model's tokens (without ends), known tokens, base scores, and logarithms of the shares within endings."""
    top, base_rest = len(v.words), np.log10(v.tokens + 0.5 * (v.distinct + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent_words, endings = (pa.array(x, pa.binary()) for x in (v.words, sorted(v.endings, key=v.endings.get)))
        for b in batches:
            for i in range(b.num_rows):
                c = {n: b.column(j)[i] for j, n in enumerate(b.schema.names)}
                ids, words, sizes = c["ids"].as_py(), c["words"].values, c["sizes"].values.to_numpy()
                all_ = from_planes(c["tokens"].as_py()).astype(np.int64)
                of = np.split(all_, np.cumsum(sizes)[:-1])
                token = pc.index_in(words, value_set=frequent_words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                other = pc.index_in(pc.binary_slice(words, -2, sys.maxsize), value_set=endings).fill_null(len(v.sums) - 1)
                token = np.where(token < 0, top + other.to_numpy(zero_copy_only=False), token)
                n = np.zeros(len(words))
                if c["at"].is_valid:
                    n[c["at"].values.to_numpy()] = c["n"].values.to_numpy()
                frequent = token < top
                n[frequent] = v.counts[token[frequent]]
                base = np.log10(n + 0.5) - base_rest
                ending = np.where(frequent, 0, token - top)
                share = np.where(frequent, 0, np.log10(n + 0.5) - np.log10(v.sums + 0.5 * (v.kinds + 1))[ending])
                last = float(np.log10(v.counts[0] + 0.5) - base_rest)
                known = [int((n[x] > 0).sum()) + int(v.counts[0] > 0) for x in of]
                tokens = token.astype("<u2")[all_].tobytes()
                columns = (ids, known, [float(base[x].sum()) + last for x in of], [float(share[x].sum()) for x in of], sizes, tokens)
                kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(columns, kinds, strict=True)], names=list(Read._fields[:4]) + ["sizes", "tokens"])
                del words, all_, of, c
                trim()

    return chunks.mapInArrow(run, READ_SCHEMA)


def learned(network: Network, rows: DataFrame, turn: int, rounds: int = ROUNDS) -> int:
    """One round: every task's network goes on with its documents of this turn, and ``network`` becomes the average.

    Returns the number of tokens learned from.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, held, size, all_ = copy.deepcopy(network), [], 0, 0

        def go_on() -> None:
            own.train(held, seed=2 + turn)
            held.clear()

        for chunk in read(batches):
            for i in range(turn % rounds, len(chunk.ids), rounds):
                if not held_out(chunk.ids[i]):
                    held.append(chunk.docs[i])
                    size += len(chunk.docs[i]) + 1
                if size >= AT_ONCE:
                    go_on()
                    size, all_ = 0, all_ + size
        if held:
            go_on()
        if all_ + size:
            vector = own.vector()
            cuts = range(0, len(vector), AVERAGED)
            columns = (list(range(len(cuts))), [all_ + size] * len(cuts), [vector[lo : lo + AVERAGED].tobytes() for lo in cuts])
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["block", "tokens", "numbers"])

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for b in batches:
            for block, tokens, numbers in zip(*(b.column(n).to_pylist() for n in ("block", "tokens", "numbers")), strict=True):
                before = sums.get(block, (0, 0))
                sums[block] = before[0] + tokens, before[1] + np.frombuffer(numbers, np.float32).astype(np.float64) * tokens
        columns = (list(sums), [n for n, _ in sums.values()], [(x / n).astype(np.float32).tobytes() for n, x in sums.values()])
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["block", "tokens", "numbers"])

    schema = "block int, tokens long, numbers binary"
    got = sorted(rows.mapInArrow(run, schema).repartition("block").mapInArrow(average, schema).collect(), key=lambda r: r["block"])  # a fixed number
    if got:
        network.take(np.frombuffer(b"".join(r["numbers"] for r in got), np.float32))
    return got[0]["tokens"] if got else 0


def log_likelihoods(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document (scores: log10)."""
    tune(docs.sparkSession)
    chunks = tokenized(docs)
    times = chunks.select(F.explode(F.arrays_zip("words", "times")).alias("w")).select(F.col("w.words").alias("word"), F.col("w.times").alias("n"))
    counts = written(times.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")))
    v, rest = vocabulary(counts)
    sent = chunks.select("part", F.posexplode("words").alias("at", "word"))
    told = sent.join(rest, "word").groupBy("part").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))  # as many as a chunk's words
    told = written(told.select(F.shiftright("part", HOME).alias("home"), "part", "at", "n"))
    discard(counts)
    rows = written(numbered(chunks.drop("times").join(told.hint("shuffle_hash"), ["home", "part"], "left"), v))
    discard(told, chunks)
    network = Network(v)
    for turn in range(ROUNDS * PASSES):
        learned(network, rows, turn)
    network.seen = {}
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def scored() -> pa.RecordBatch:
            ids, known, base, share, docs_ = (list(x) for x in zip(*held, strict=True))
            scores = network.scored(docs_) / np.log(10) + np.array(share)
            sizes = [len(d) + 1 for d in docs_]
            out = [None if i is None else held_out(i) for i in ids]
            columns = (ids, out, sizes, known, [v.tokens] * len(ids), base, scores.tolist())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.bool_(), *[pa.int64()] * 3, pa.float64(), pa.float64()), strict=True)], names=[x.split()[0] for x in schema.split(", ")])

        size = 0
        for chunk in read(batches):
            held += zip(*chunk, strict=True)
            size += sum(map(len, chunk.docs))
            if size > TOGETHER:
                yield scored()
                held.clear()
                size = 0
                trim()
        if held:
            yield scored()

    return rows.mapInArrow(score, schema)
