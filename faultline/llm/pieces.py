"""Encoding and decoding with a SentencePiece vocabulary by suffix-array matching."""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from faultline.llm.tokens import vocabulary

SPACE = "▁"
SHORT = 64  # up to as many characters, looking at all edges beats a heap
_UNIT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def suffix_order(codes: np.ndarray, depth: int) -> np.ndarray:
    """Places of ``codes`` in order of what follows them, as far as ``depth`` characters.

    Prefix doubling: ranks by one character give ranks by two, these by four, and so on.
    """
    ranks = np.unique(codes, return_inverse=True)[1].astype(np.int64) + 1
    order, seen = np.argsort(ranks), 1
    while seen < depth:
        later = np.zeros_like(ranks)
        later[:-seen] = ranks[seen:]
        keys = ranks * (len(codes) + 2) + later
        order = np.argsort(keys)
        steps = np.diff(keys[order], prepend=keys[order[0]]) != 0
        ranks[order] = np.cumsum(steps) + 1
        seen *= 2
    return order


def occurrence_ranges(codes: np.ndarray, order: np.ndarray, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one place in ``order`` of every pattern, all binary searches at once."""
    padded = np.concatenate([codes, np.zeros(patterns.shape[1], codes.dtype)])
    inside = np.arange(patterns.shape[1]) < lengths[:, None]

    def search(past_equal: bool) -> np.ndarray:
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(order))
        while (low < high).any():
            middle = (low + high) // 2
            at = order[np.minimum(middle, len(order) - 1)]
            text = padded[at[:, None] + np.arange(patterns.shape[1])]
            differs = (text != patterns) & inside
            first = differs.argmax(axis=1)
            rows = np.arange(len(patterns))
            equal = ~differs[rows, first]
            below = text[rows, first] < patterns[rows, first]
            right = (low < high) & np.where(equal, past_equal, below)
            high = np.where((low < high) & ~right, middle, high)
            low = np.where(right, middle + 1, low)
        return low

    return search(False), search(True)


class PieceCoder:
    """Ids of whole texts as the SentencePiece library gives them for a byte-pair vocabulary.

    No piece of such a vocabulary has a blank after another character (checked on opening), so texts
    are cut before blanks and each different unit is encoded once while it is remembered. New units
    of a batch are concatenated and indexed by a suffix array; every piece is searched for in it;
    its occurrences are edges between two places, sorted by place. Relaxing a unit takes, again and
    again, the best-scored edge over exactly two adjacent stretches (the left one among equals),
    until none is left; this is what byte-pair merging does, with edges in place of a table of
    strings. A shortest path over the edges would be the rule of unigram vocabularies and gives
    other ids here.
    """

    def __init__(self, name: str = "piece_bpe_32k.model", remembered: int = 800_000):
        from sentencepiece import SentencePieceProcessor

        self.library = sp = SentencePieceProcessor(model_file=vocabulary(name))
        n = sp.piece_size()
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(n)]
        self.bytes_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        plain = [i for i in range(n) if not special[i] and not sp.is_byte(i)]
        texts = [sp.id_to_piece(i) for i in plain]
        if any(SPACE in t.lstrip(SPACE) for t in texts):
            raise ValueError("pieces run across blanks: texts cannot be cut before them")
        self.plain, self.ids = plain, np.array(plain)
        self.lengths = np.array([len(t) for t in texts])
        self.scores = np.array([sp.get_score(i) for i in plain])
        self.ranks = np.unique(-self.scores, return_inverse=True)[1].tolist()
        self.depth = int(self.lengths.max())
        self.width = self.depth + 1  # an edge is its start times this plus its length
        self.patterns = np.zeros((len(texts), self.depth), np.uint32)
        for k, t in enumerate(texts):
            self.patterns[k, : len(t)] = np.frombuffer(t.encode("utf-32-le"), "<u4")
        self.shown = {i: t.encode() for i, t in zip(plain, texts)}
        self.shown |= {i: bytes([b]) for b, i in self.bytes_ids.items()}
        self.unknown = sp.unk_id()
        self.remembered, self.known, self.older = remembered, {}, {}

    def _edges(self, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        order = suffix_order(codes, self.depth)
        first, last = occurrence_ranges(codes, order, self.patterns, self.lengths)
        counts = last - first
        piece = np.repeat(np.arange(len(counts)), counts)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
        place = order[first[piece] + within]
        edges = place * self.width + self.lengths[piece]
        by_place = np.argsort(edges)
        return edges[by_place], piece[by_place]

    def _learn(self, units: list[str]) -> None:
        """Encode new units together."""
        codes = np.frombuffer("\0".join(units).encode("utf-32-le"), "<u4")
        edges, piece = self._edges(codes)
        single = edges % self.width == 1
        letters = np.full(len(codes), -1)
        letters[edges[single] // self.width] = self.ids[piece[single]]
        letters, table = letters.tolist(), dict(zip(edges[~single].tolist(), piece[~single].tolist()))
        base = 0
        for unit in units:
            n = len(unit)
            cuts = self._relaxed(base, n, table) if n <= SHORT else self._relaxed_long(base, n, table)
            out = []
            for a, b in zip(cuts, cuts[1:]):
                if b - a > 1:
                    out.append(self.plain[table[a * self.width + b - a]])
                elif letters[a] >= 0:
                    out.append(letters[a])
                else:
                    raw = unit[a - base].encode()
                    out += [self.bytes_ids[x] for x in raw] if self.bytes_ids else [self.unknown]
            self.known[unit] = array("I", out).tobytes()
            base += n + 1

    def _relaxed(self, base: int, n: int, table: dict[int, int]) -> list[int]:
        """Places between the pieces of ``n`` characters: the best edge is found by looking at all."""
        width, ranks, get = self.width, self.ranks, table.get
        cuts = list(range(base, base + n + 1))
        none = len(ranks)
        found = [get(k) for k in range(base * width + 2, (base + n - 1) * width + 2, width)]
        order = [none if f is None else ranks[f] for f in found]
        while order:
            best = min(order)
            if best == none:
                break
            k = order.index(best)
            del cuts[k + 1], order[k]
            if k < len(order):
                f = get(cuts[k] * width + cuts[k + 2] - cuts[k])
                order[k] = none if f is None else ranks[f]
            if k:
                f = get(cuts[k - 1] * width + cuts[k + 1] - cuts[k - 1])
                order[k - 1] = none if f is None else ranks[f]
        return cuts

    def _relaxed_long(self, base: int, n: int, table: dict[int, int]) -> list[int]:
        """The same with a heap, in time n log n."""
        width, ranks, get = self.width, self.ranks, table.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = []

        def add(a: int, b: int, c: int) -> None:
            f = get((base + a) * width + c - a)
            if f is not None:
                heapq.heappush(waiting, (ranks[f], a, b, c))

        for k in range(n - 1):
            add(k, k + 1, k + 2)
        while waiting:
            _, a, b, c = heapq.heappop(waiting)
            if after[a] != b or after[b] != c:
                continue
            after[a], after[b] = c, -1
            if c < n:
                before[c] = a
                add(a, c, after[c])
            if before[a] >= 0:
                add(before[a], a, c)
        cuts, k = [base], 0
        while k < n:
            k = after[k]
            cuts.append(base + k)
        return cuts

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is the empty text."""
        if len(self.known) > self.remembered:
            self.older, self.known = self.known, {}
        cut = [_UNIT.findall(self.library.normalize(t)) if t else [] for t in texts]
        new = []
        for unit in {u for units in cut for u in units}:
            if unit not in self.known:
                if unit in self.older:
                    self.known[unit] = self.older[unit]
                else:
                    new.append(unit)
        if new:
            self._learn(new)
        return [b"".join(map(self.known.__getitem__, units)) for units in cut]

    def decode(self, ids: bytes) -> str:
        """The normalised text of the ids, its blanks shown as blanks."""
        raw = b"".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").replace(SPACE, " ").removeprefix(" ")


_coders: dict[str, PieceCoder] = {}


def coder(name: str) -> PieceCoder:
    if name not in _coders:
        _coders[name] = PieceCoder(name)
    return _coders[name]


def encode_documents(docs: DataFrame, name: str = "piece_bpe_32k.model") -> DataFrame:
    """doc_id, n_tokens, the checksum of the ids, and whether decoding gives the text back, of every document.

    Null and empty texts have no ids. The sign that stands for blanks in pieces comes back as a
    blank. Repeated rows are encoded alike, no documents give no rows, other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = coder(name)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = both.encode(texts)
            same = [both.decode(i) == (t or "").replace(SPACE, " ") for i, t in zip(ids, texts)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(i) // 4 for i in ids], pa.int64()),
                    pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                    pa.array(same, pa.bool_()),
                ],
                ["doc_id", "n_tokens", "ids_crc32", "round_trip"],
            )

    kept = docs.select("doc_id", "text")
    return kept.mapInArrow(run, kept.drop("text").schema.add("n_tokens", "long").add("ids_crc32", "long").add("round_trip", "boolean"))
