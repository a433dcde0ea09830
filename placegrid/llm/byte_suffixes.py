"""Repeated byte strings through merged Burrows-Wheeler transforms of shards.

A byte is removed if a string of ``LENGTH`` bytes of its document covers it that also starts anywhere else.

Texts are parsed at content-defined anchors (positions whose hash of ``GRAM`` bytes falls into one class of ``SPARSE``),
so the parse inside a repeat is the same in all its copies. A phrase runs from an anchor to the end of the next one; the
first and last phrases of a document run from its start and to its end. Each shard (chunk) sorts the suffixes of its
parse and takes the phrase before each: its Burrows-Wheeler transform. Transforms are merged by iterative interleave
refinement: starting from one block that holds all shards one after another, round h splits each block by phrase h.
Within a block a shard's suffixes are in their order already, so a round only merges runs and no suffix is sorted
again; blocks of one suffix are finished. The round in which suffixes part is the length of their common prefix, blocks of
two or more are the repeated intervals, and the transform's symbols tell which of them can be extended to the left.

The intervals decide. A string lies between the phrase before its first anchor and the phrase after its last one. If
the suffix at its first anchor shares the anchors inside with no other, it does not repeat. If it shares them, and all
that share them also have the same phrase before and after, it repeats. Only what is left (strings at the ends of
repeats, where the phrases around differ, and strings without an anchor) is compared as whole strings by 128-bit hashes.
Equal strings always fall into the same case, so this loses nothing.

A whole transform is walked by LF-mapping, and that of a corpus would have to lie in one task for it. So transforms are
cut by ranges of the first phrase, and with each symbol go the ``DEPTH`` + 1 phrases that the rounds in its range read;
longer strings are followed from interval to interval.

Nulls and edges: a null text is empty; texts shorter than LENGTH keep all; repeated rows remove each other; a null doc_id
is treated like any other; extra columns are ignored; an empty table gives no rows. A task holds a document whole, so its
memory bounds a document's length. An interval's members agree in at least 112 bits of hashes, compared strings in 128.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from placegrid.llm.common import mix, partitions
from placegrid.llm.exchange import Chunk, Keys, chunked, covered, cut, differing, distinct, exchanged, finished, from_reply, prefix_sums, stacked, wide_hashes, window_hashes

LENGTH, GRAM, SPARSE, DEPTH = 200, 24, 40, 4
#: Bits of an anchor's hash that are sent.
ANCHOR_BITS = 48
#: Bytes hashed at once.
BLOCK = 1 << 19
TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: What is known of the strings that begin in a suffix's interval of a depth.
SINGLE, MIXED, SAME_AFTER, SAME = range(4)


def blocks(chunk: Chunk) -> Iterator[tuple[list[bytes], int]]:
    """Runs of documents of about BLOCK bytes, with the number of bytes before each."""
    held, total, before = [], 0, 0
    for t in chunk.texts:
        if held and total + len(t) > BLOCK:
            yield held, before
            held, before, total = [], before + total, 0
        held.append(t)
        total += len(t)
    if held:
        yield held, before


class Block:
    """Prefix sums of the documents' bytes, and for each position the end of its document."""

    def __init__(self, texts: list[bytes]) -> None:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.stop = np.cumsum(size)
        self.end = np.repeat(self.stop, size).astype(np.int32)
        self.values = TABLE[self.bytes]
        self.sums, self.down = prefix_sums(self.values)

    def starts(self, size: int) -> np.ndarray:
        at = np.arange(len(self.end), dtype=np.int32)
        return at[at + size <= self.end]

    def hashes(self, start: np.ndarray, size: int) -> np.ndarray:
        return window_hashes(self.sums, self.down, start, size)

    def spans(self, start: np.ndarray, stop: np.ndarray, edge: np.ndarray) -> np.ndarray:
        """32-bit hashes of the strings from start to stop; ``edge``: whether a document begins or ends there."""
        size = (2 * (stop - start) + edge).astype(np.uint64)
        h = mix((self.sums[stop] - self.sums[start]) * self.down[start] + size * np.uint64(0xC2B2AE3D27D4EB4F))
        return (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


class Parse:
    """Anchors of a chunk, and its transform: sorted suffixes of the parse and the symbol before each.

    ``keys``: the anchor's hash, then DEPTH + 1 columns: the phrases that follow, and the phrase before.
    """

    def __init__(self, chunk: Chunk) -> None:
        at, gram, after, before_, last = [], [], [], [], []
        for texts, before in blocks(chunk):
            b = Block(texts)
            start = b.starts(GRAM)
            h = b.hashes(start, GRAM)
            on = h % np.uint64(SPARSE) == 0
            a = start[on].astype(np.int64)
            end = b.end[a].astype(np.int64)
            doc = np.searchsorted(b.stop, a, side="right")
            begin = np.r_[0, b.stop][doc] if len(a) else a
            final = np.r_[doc[1:] != doc[:-1], True] if len(a) else np.zeros(0, bool)  # the last anchor of its document
            first = np.r_[True, final[:-1]] if len(a) else final
            phrase = b.spans(a, np.where(final, end, np.r_[a[1:], 0] + GRAM), final)
            at.append(a + before)
            gram.append(h[on])
            after.append(phrase)
            before_.append(np.where(first, b.spans(np.where(first, begin, a), a + GRAM, first), np.r_[np.uint32(0), phrase[:-1]]))
            last.append(final)
        cat = lambda x, kind: np.concatenate([np.zeros(0, kind), *x])
        self.at, final = cat(at, np.int64), cat(last, bool)
        key = cat(gram, np.uint64) >> np.uint64(64 - ANCHOR_BITS) << np.uint64(64 - ANCHOR_BITS)
        phrase, n = cat(after, np.uint32), len(self.at)
        more = np.zeros((n, DEPTH + 1), np.uint32)
        inside = np.ones(n, bool)  # whether the phrase still belongs to the suffix's document
        for h in range(DEPTH):
            more[: n - h, h] = np.where(inside[: n - h], phrase[h:], 0) if h < n else 0
            inside[: max(n - h, 0)] &= ~final[h:]
        more[:, DEPTH] = cat(before_, np.uint32)
        self.keys, self.row = distinct(key, more)

    def states(self, reply: bytes) -> np.ndarray:
        """For each anchor two bits a depth."""
        return from_reply(reply, len(self.keys.key), 8)[self.row]


def merged(shards: list[Keys]) -> list[np.ndarray]:
    """Interleave refinement of the shards' transforms; for each suffix, at each depth, the state of its interval."""
    key, more, asked, several = stacked(shards)
    weight, before = 1 + several.astype(np.int64), more[:, -1]
    state = np.zeros(len(key), np.uint8)
    live, own = np.arange(len(key)), np.zeros(len(key), np.uint64)
    alike = np.ones(1, bool)
    for h in range(DEPTH + 1):
        if not len(live):
            break
        symbol = key if h == 0 else (own << np.uint64(32)) | more[live, h - 1]
        order = np.argsort(symbol, kind="stable")  # merges the runs that the shards' suffixes form within each block
        live, symbol, own = live[order], symbol[order], own[order]
        start = np.flatnonzero(differing(symbol, None))
        size = np.diff(np.r_[start, len(live)])
        if h:
            whole = np.bincount(own[start].astype(np.int64), minlength=len(alike))[own.astype(np.int64)] == 1  # this round did not split the block
            state[live] |= (MIXED + whole.astype(np.uint8) + (whole & alike[own.astype(np.int64)])) << np.uint8(2 * (h - 1))
        stay = np.add.reduceat(weight[live], start) > 1
        low, high = np.minimum.reduceat(before[live], start), np.maximum.reduceat(before[live], start)
        alike = (low == high)[stay]
        on = np.repeat(stay, size)
        live, own = live[on], np.repeat(np.arange(len(alike), dtype=np.uint64), size[stay])
    return cut(state, shards, asked)


def judged(at: np.ndarray, state: np.ndarray, b: Block, before: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts in the block of the strings that repeat, and of those that the intervals do not decide."""
    lo, hi = np.searchsorted(at, [before, before + len(b.end)])
    count = np.zeros(len(b.end) + 2, np.int32)  # anchors before each position, by one running sum
    count[at[lo:hi] - before + 1] = 1
    np.cumsum(count, out=count)
    start = b.starts(length)
    first = count[start]
    inside = count[start + (length - GRAM + 1)] - first
    state = np.r_[state[lo:hi], np.uint8(0)]
    found = (state[first] >> (2 * (np.clip(inside, 1, DEPTH) - 1)).astype(np.uint8)) & np.uint8(3)
    found[inside <= 0] = MIXED
    far = np.flatnonzero(inside > DEPTH)
    if len(far):  # intervals of DEPTH phrases, one after another up to the last anchor
        top = state >> np.uint8(2 * (DEPTH - 1)) & np.uint8(3)
        alone, loose = (np.r_[0, np.cumsum(x)].astype(np.int32) for x in (top == SINGLE, top < SAME_AFTER))
        f = first[far]
        end = f + inside[far] - DEPTH + 1
        found[far] = np.where(alone[end] > alone[f], SINGLE, np.where((loose[end] == loose[f]) & (top[f] == SAME), SAME, MIXED))
    return start[found == SAME], start[(found == MIXED) | (found == SAME_AFTER)]


class Strings:
    """Starts (within the chunk) of the strings that repeat by the intervals, and the others' starts and hashes."""

    def __init__(self, chunk: Chunk, reply: bytes, length: int) -> None:
        p = Parse(chunk)
        state, known, at, key, half = p.states(reply), [], [], [], []
        for texts, before in blocks(chunk):
            b = Block(texts)
            yes, maybe = judged(p.at, state, b, before, length)
            known.append(yes.astype(np.int64) + before)
            at.append(maybe.astype(np.int64) + before)
            h, more = wide_hashes(b.values, b.sums, b.down, maybe, length)
            key.append(h)
            half.append(more)
        self.known, self.at = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (known, at))
        self.keys, self.place = distinct(np.concatenate([np.zeros(0, np.uint64), *key]), np.concatenate([np.zeros((0, 2), np.uint32), *half]))


def whole_characters(text: bytes, gone: np.ndarray) -> str:
    """The text without the UTF-8 characters of which every byte is removed."""
    data = np.frombuffer(text, np.uint8)
    first = np.flatnonzero((data & 0xC0) != 0x80)
    keep = ~np.logical_and.reduceat(gone, first)
    return data[np.repeat(keep, np.diff(np.r_[first, len(data)]))].tobytes().decode("utf-8", "replace")


def remove_repeats(docs: DataFrame, length: int = LENGTH, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (remaining bytes), kept_sha256, spans (starts and ends of removed runs).

    Besides, ``text`` (as kept, but characters that are removed in part stay whole) and the columns ``carry``, as strings.
    """
    ranges = partitions(docs, 6 << 20)
    chunks = chunked(docs, carry)
    parsed = exchanged(chunks, "prefix", lambda c, _: Parse(c).keys, merged, ranges, bits=8)
    compared = exchanged(parsed, "same", lambda c, got: Strings(c, got["prefix"], length).keys, ranges=ranges)

    def finish(c: Chunk, got: dict[str, bytes]) -> dict:
        s = Strings(c, got["prefix"], length)
        again = from_reply(got["same"], len(s.keys.key), 1).astype(bool)
        size = np.array([len(t) for t in c.texts], np.int64)
        flags = np.zeros(int(size.sum()), bool)
        flags[s.known] = True
        flags[s.at[again[s.place]]] = True
        gone = covered(flags, length)
        out: dict = {"doc_id": c.ids, "n_bytes": size, "n_removed": [], "n_spans": [], "kept": [], "kept_sha256": [], "spans": [], "text": []}
        out |= {f"carried_{i}": x for i, x in enumerate(c.carried)}
        for text, hi in zip(c.texts, np.cumsum(size).tolist(), strict=True):
            mask = gone[hi - len(text) : hi]
            turn = np.flatnonzero(np.diff(np.r_[False, mask, False])).tolist()
            kept = np.frombuffer(text, np.uint8)[~mask].tobytes() if turn else text
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(turn) // 2)
            out["kept"].append(kept)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["spans"].append(turn)
            out["text"].append(whole_characters(text, mask) if turn else text.decode("utf-8", "replace"))
        return out

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string, spans array<int>, text string"
    found = finished(compared, finish, ", ".join([schema, *(f"carried_{i} string" for i in range(len(carry)))]))
    return found.withColumnsRenamed({f"carried_{i}": c for i, c in enumerate(carry)})
