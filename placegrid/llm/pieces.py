"""SentencePiece encoding and decoding by batched numpy Viterbi, or batched merges where the model was trained by merges.

A text gets the model's dummy space in front; spaces count as U+2581. No piece of the vocabulary joins a space to
what stands before it, and none holds a line feed, so a text falls into units (spaces and the word after them, or a line
feed) that are segmented one by one; the constructor checks this. Distinct units are encoded once by a worker. Units of
equal length advance together: for each end position the hashes of all substrings that end there probe the sorted hashes of
the pieces, and a vectorised maximum over best[start] + score keeps the backpointer. A character without a piece costs
the unknown penalty and becomes its byte pieces.

For unigram models this gives the highest sum of piece scores, as the library does. Where a model's type is BPE (such as
piece_bpe_32k.model), the highest sum is not what the library returns, so there the same batches and the same hash probes
replay the merges: all words of a batch merge their best adjacent pair at a time (leftmost among equals), which leaves
them with equally many parts, until nothing merges. A unit of more than ``LONG`` characters takes its merges from a heap
instead, where only the pairs beside a merge are looked up again, so its time grows like n log n.

Nulls and edges: a null or empty text has no ids; repeated rows encode alike; a text that holds U+2581 itself decodes to
spaces there (round_trip is then false); an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from placegrid.llm.common import mapped, mix, texts, trim, tune
from placegrid.llm.exchange import BASE, INVERSE, powers

CACHE = 150_000
SPACE = "▁"
UNIT = re.compile(r"\n| *[^ \n]+| +")
#: How far below the least score an unknown character is.
PENALTY = 10.0
#: Units of one length that advance together.
ROWS = 4096
#: Characters above which a unit is merged by itself.
LONG = 100


def model_type(path: str) -> int:
    """trainer_spec.model_type of a model file: 1 unigram (also if absent), 2 BPE."""

    def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
        at = 0

        def number() -> int:
            nonlocal at
            value = shift = 0
            while True:
                value |= (data[at] & 127) << shift
                shift, at = shift + 7, at + 1
                if data[at - 1] < 128:
                    return value

        while at < len(data):
            tag = number()
            size = {0: None, 1: 8, 5: 4}.get(tag & 7, -1)
            if size is None:
                yield tag >> 3, number()
                continue
            size = number() if size < 0 else size
            yield tag >> 3, data[at : at + size]
            at += size

    with open(path, "rb") as f:
        spec = next((v for k, v in fields(f.read()) if k == 2), b"")
    return next((v for k, v in fields(spec) if k == 3), 1)


class Viterbi:
    """Vocabulary tables of a SentencePiece model, and the batched segmentation."""

    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.unknown = model.unk_id()
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        if any(SPACE in names[i].lstrip(SPACE) or "\n" in names[i] for i in normal):
            raise ValueError("a piece of this vocabulary crosses units")
        score = np.array([model.get_score(i) for i in normal])
        self.least = float(score.min()) - PENALTY
        self.longest = max(len(names[i]) for i in normal)
        self.down = powers(INVERSE, 1 << 10)
        key = np.array([self.hashed(self.points([names[i]]))[0][0, -1] for i in normal], np.uint64)
        order = np.argsort(key)
        self.key, self.id, self.score = key[order], np.array(normal)[order], score[order]
        if (self.key[1:] == self.key[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.text = [bytes([int(names[i][3:5], 16)]) if model.is_byte(i) else b"" if model.is_control(i) else names[i].replace(SPACE, " ").encode() for i in range(n)]
        self.pieces = dict(zip((names[i] for i in normal), zip((-score).tolist(), normal, strict=True), strict=True))
        self.known: dict[str, bytes] = {}
        self.split = self.merge if model_type(path) == 2 else self.segment

    @staticmethod
    def points(units: list[str]) -> np.ndarray:
        """Code points of units of equal length, one row each."""
        return np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(units), -1).astype(np.uint64)

    def hashed(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of all of each row, prefix sums) of polynomial hashes; a hash covers content and length."""
        n, size = points.shape
        sums = np.zeros((n, size + 1), np.uint64)
        np.cumsum(mix(points + np.uint64(1)) * powers(BASE, size)[None, :], axis=1, out=sums[:, 1:])
        return mix(sums[:, -1:] + np.uint64(size)), sums

    def segment(self, units: list[str]) -> list[list[int]]:
        """Ids of units of equal length."""
        points = self.points(units)
        n, size = points.shape
        _, sums = self.hashed(points)
        down = self.down if size <= len(self.down) else powers(INVERSE, size)
        best = np.full((n, size + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, size + 1), np.int32), np.full((n, size + 1), -1, np.int32)
        row = np.arange(n)
        for end in range(1, size + 1):
            lo = max(0, end - self.longest)
            h = mix((sums[:, end : end + 1] - sums[:, lo:end]) * down[lo:end] + np.arange(end - lo, 0, -1).astype(np.uint64))
            at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
            hit = self.key[at] == h
            value = best[:, lo:end] + np.where(hit, self.score[at], -np.inf)
            lone = ~hit[:, -1]
            value[lone, -1] = best[lone, end - 1] + self.least
            start = value.argmax(axis=1)
            best[:, end], back[:, end] = value[row, start], start + lo
            piece[:, end] = np.where(hit[row, start], self.id[at[row, start]], -1)
        out = []
        for i, unit in enumerate(units):
            ids, end = [], size
            while end:
                start = back[i, end]
                ids += [int(piece[i, end])] if piece[i, end] >= 0 else self.fallback(unit[start:end])[::-1]
                end = start
            out.append(ids[::-1])
        return out

    def probe(self, sums: np.ndarray, down: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Index of the piece from start to end of each row (2-d arrays), or -1."""
        row = np.arange(len(sums))[:, None]
        h = mix((sums[row, end] - sums[row, start]) * down[start] + (end - start).astype(np.uint64))
        at = np.minimum(np.searchsorted(self.key, h), len(self.key) - 1)
        return np.where(self.key[at] == h, at, -1)

    def merge(self, units: list[str]) -> list[list[int]]:
        """Ids of units of equal length, by merging the pair of the best piece again and again."""
        if len(units[0]) > LONG:
            return list(map(self.merge_one, units))
        points = self.points(units)
        n, size = points.shape
        _, sums = self.hashed(points)
        down = self.down if size <= len(self.down) else powers(INVERSE, size)
        live, cuts = np.arange(n), np.tile(np.arange(size + 1), (n, 1))
        done: list[list[int]] = [[]] * n

        def close(rows: np.ndarray, cuts: np.ndarray) -> None:
            if len(rows):
                at = self.probe(sums[rows], down, cuts[:, :-1], cuts[:, 1:])
                for r, ids, c in zip(rows.tolist(), np.where(at >= 0, self.id[at], -1).tolist(), cuts.tolist(), strict=True):
                    done[r] = [x for i, j in enumerate(ids) for x in ((j,) if j >= 0 else self.fallback(units[r][c[i] : c[i + 1]]))]

        while len(live) and cuts.shape[1] > 2:
            at = self.probe(sums[live], down, cuts[:, :-2], cuts[:, 2:])
            value = np.where(at >= 0, self.score[at], -np.inf)
            best = value.argmax(axis=1)
            on = np.isfinite(value[np.arange(len(live)), best])
            close(live[~on], cuts[~on])
            live, cuts, best = live[on], cuts[on], best[on]
            keep = np.ones(cuts.shape, bool)
            keep[np.arange(len(live)), best + 1] = False
            cuts = cuts[keep].reshape(len(live), cuts.shape[1] - 1)
        close(live, cuts)
        return done

    def merge_one(self, unit: str) -> list[int]:
        """Ids of one unit: the best pair (leftmost among equals) comes from a heap."""
        n, pieces, longest = len(unit), self.pieces, self.longest
        stop, before, gone = list(range(1, n + 1)), list(range(-1, n)), bytearray(n)
        heap = [(got[0], i, i + 2) for i in range(n - 1) if (got := pieces.get(unit[i : i + 2]))]
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = stop[i]
            if gone[i] or middle >= n or stop[middle] != end:
                continue  # one of its parts has been merged since
            stop[i], gone[middle], before[end] = end, 1, i
            left = before[i]
            if left >= 0 and end - left <= longest and (got := pieces.get(unit[left:end])):
                heapq.heappush(heap, (got[0], left, end))
            if end < n and stop[end] - i <= longest and (got := pieces.get(unit[i : stop[end]])):
                heapq.heappush(heap, (got[0], i, stop[end]))
        ids, i = [], 0
        while i < n:
            part = unit[i : stop[i]]
            ids += [pieces[part][1]] if part in pieces else self.fallback(part)
            i = stop[i]
        return ids

    def fallback(self, character: str) -> list[int]:
        data = character.encode("utf-8", "replace")
        return [self.bytes[b] for b in data] if self.bytes else [self.unknown]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes."""
        found = [UNIT.findall(" " + t) if t else [] for t in texts]
        if len(self.known) >= CACHE:
            self.known.clear()
            trim()
        by_length: dict[int, list[str]] = {}
        for u in {u for us in found for u in us if u not in self.known}:
            by_length.setdefault(len(u), []).append(u)
        for size, units in by_length.items():
            step = max(1, min(ROWS, (1 << 20) // size))
            for at in range(0, len(units), step):
                some = units[at : at + step]
                for u, ids in zip(some, self.split([x.replace(" ", SPACE) for x in some]), strict=True):
                    self.known[u] = np.array(ids, "<u4").tobytes()
        return [b"".join(map(self.known.__getitem__, us)) for us in found]

    def decode(self, ids: bytes) -> bytes:
        """The text (UTF-8) of ids, without the dummy space."""
        data = b"".join(map(self.text.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return data[1:] if data[:1] == b" " else data


_models: dict[str, Viterbi] = {}


def encoded(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_ids, ids, ids_crc32, decoded_sha256, round_trip of every whole text."""
    tune(docs.sparkSession)

    def run(c: dict) -> dict:
        if model not in _models:
            _models[model] = Viterbi(model)
        own = [t or b"" for t in c["text"]]
        ids = _models[model].encode([t.decode("utf-8", "replace") for t in own])
        back = [_models[model].decode(i) for i in ids]
        return {
            "doc_id": c["doc_id"], "n_ids": [len(i) // 4 for i in ids], "ids": [np.frombuffer(i, "<i4") for i in ids], "ids_crc32": [zlib.crc32(i) for i in ids],
            "decoded_sha256": [hashlib.sha256(b).hexdigest() for b in back], "round_trip": [a == b for a, b in zip(own, back, strict=True)],
        }

    return mapped(texts(docs), run, "doc_id long, n_ids long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean")
