"""Byte-level byte-pair coding: a perfect hash for whole pre-tokens, a heap over linked bytes for the others."""

from __future__ import annotations

import base64
import heapq
import re
import sys
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.tokens import vocabulary

RANKS = "byte_bpe_multi_50k.tiktoken"
# A run of ASCII white space opens a unit; other white space joins no such run.
_UNIT = re.compile(r"[ \t-\r]+[^ \t-\r]*|[^ \t-\r]+")
_OTHER_SPACE = re.compile("[\x85\xa0  -     　]")
LONGEST_REMEMBERED = 64


class MinimalPerfectHash:
    """Numbers 0 to n-1 for n different 64-bit hashes, without storing them.

    Level by level every remaining hash picks a bit; those alone on theirs stay there, the others go
    to the next level. A hash's number is the count of bits before its own. Hashes that were not
    there when it was built get any number, or -1.
    """

    LEVELS = 60

    def __init__(self, hashes: np.ndarray, room: float = 2.0):
        self.levels: list[tuple[int, np.ndarray]] = []
        left, placed = hashes, 0
        while len(left):
            if len(self.levels) == self.LEVELS:
                raise ValueError("two keys have the same hash")
            size = int(room * len(left)) + 1
            at = self._places(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            numbers = np.where(alone, placed + np.cumsum(alone) - 1, -1).astype(np.int32)
            self.levels.append((size, numbers))
            placed += int(alone.sum())
            left = left[~alone[at]]
        self.size = placed

    @staticmethod
    def _places(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        mixed = (hashes + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(32)
        return ((mixed * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(20)) % np.uint64(size)).astype(np.int64)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        found = np.full(len(hashes), -1, np.int64)
        waiting = np.arange(len(hashes))
        for level, (size, numbers) in enumerate(self.levels):
            here = numbers[self._places(hashes[waiting], level, size)]
            found[waiting] = here
            waiting = waiting[here < 0]
        return found


def _ranges(points: set[int]) -> str:
    """The points as the inside of a character set."""
    out: list[list[int]] = []
    for p in sorted(points):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


@cache
def splitter(pattern: str) -> regex.Pattern:
    """The pattern with letters and numbers as the tiktoken library knows them.

    The two regular-expression engines follow different versions of Unicode. Which characters the
    library takes for letters is asked of itself, with a vocabulary of single bytes.
    """
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    every = "".join(chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000)
    for kind in (r"\p{L}", r"\p{N}"):
        library = tiktoken.Encoding(kind, pat_str=f"{kind}+", mergeable_ranks=single, special_tokens={})
        theirs = set(map(ord, bytes(library.encode_ordinary(every)).decode()))
        ours = {ord(c) for c in regex.findall(kind, every)}
        exact = kind
        if ours - theirs:
            exact = f"[{exact}--[{_ranges(ours - theirs)}]]"
        if theirs - ours:
            exact = f"[{exact}||[{_ranges(theirs - ours)}]]"
        pattern = pattern.replace(kind, exact)
    return regex.compile(pattern, regex.V1)


class ByteCoder:
    """Ids of whole texts as the tiktoken library gives them for a file of ranks, and the way back.

    No match of the pattern runs from another character into white space, so texts are cut before
    white space and each different unit is split once; short ones are remembered from batch to batch. All its different pre-tokens are
    looked up together: a minimal perfect hash names the one token each can be, and comparing the
    bytes decides. Pre-tokens that are no token are merged, lowest rank and leftmost first, by a
    heap of pairs over linked bytes in time n log n; short ones are remembered.
    """

    def __init__(self, name: str = RANKS, remembered: int = 300_000):
        import public_tokenizers

        with open(vocabulary(name), "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.shown = {rank: token for token, rank in self.ranks.items()}
        tokens = list(self.ranks)
        self.hash = MinimalPerfectHash(self._hashes(tokens))
        order = np.argsort(self.hash.numbers(self._hashes(tokens)))
        self.tokens = [tokens[k] for k in order]
        self.ids = [np.array([self.ranks[t]], "<u4").tobytes() for t in self.tokens]
        self.split = splitter(public_tokenizers.PATTERN)
        self.remembered, self.merged, self.older, self.coded = remembered, {}, {}, {}

    @staticmethod
    def _hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token by merging its bytes."""
        ranks, rank_of, n = self.ranks, self.ranks.get, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pairs = ((rank_of(piece[k : k + 2]), k, k + 1, k + 2) for k in range(n - 1))
        waiting = [pair for pair in pairs if pair[0] is not None]
        heapq.heapify(waiting)
        while waiting:
            _, a, b, c = heapq.heappop(waiting)
            if after[a] != b or after[b] != c:
                continue  # one of the two parts has grown meanwhile
            after[a], after[b] = c, -1
            if c < n:
                before[c] = a
                rank = rank_of(piece[a : after[c]])
                if rank is not None:
                    heapq.heappush(waiting, (rank, a, c, after[c]))
            left = before[a]
            if left >= 0:
                rank = rank_of(piece[left:c])
                if rank is not None:
                    heapq.heappush(waiting, (rank, left, a, c))
        out, k = [], 0
        while k < n:
            out.append(ranks[piece[k : after[k]]])
            k = after[k]
        return out

    def _miss(self, piece: bytes) -> bytes:
        ids = self.merged.get(piece) or self.older.get(piece)
        if ids is None:
            ids = np.array(self.merge(piece), "<u4").tobytes()
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self.merged) >= self.remembered:
                self.older, self.merged = self.merged, {}
            self.merged[piece] = ids
        return ids

    def _pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of different pre-tokens."""
        raw = [p.encode() for p in pieces]
        numbers = self.hash.numbers(self._hashes(raw)).tolist()
        tokens, ids = self.tokens, self.ids
        return {
            piece: ids[k] if k >= 0 and tokens[k] == key else self._miss(key)
            for piece, key, k in zip(pieces, raw, numbers)
        }

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; null is the empty text."""
        cut = [self._units(t) if t else [] for t in texts]
        if len(self.coded) >= self.remembered:
            self.coded = {}
        fresh = set().union(*cut).difference(self.coded)
        split = {unit: self.split.findall(unit) for unit in fresh}
        ids = self._pieces(list(set().union(*split.values())))
        coded = self.coded
        coded.update((unit, b"".join(map(ids.__getitem__, pieces))) for unit, pieces in split.items())
        out = [b"".join(map(coded.__getitem__, units)) for units in cut]
        for unit in fresh:
            if len(unit) > LONGEST_REMEMBERED:
                del coded[unit]
        return out

    @staticmethod
    def _units(text: str) -> list[str]:
        if not text.isascii() and _OTHER_SPACE.search(text):
            return [text]
        return _UNIT.findall(text)

    def decode(self, ids: bytes) -> bytes:
        """The bytes the ids stand for, which need not be whole characters for any ids."""
        return b"".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@cache
def coder(name: str) -> ByteCoder:
    """One coder per worker process and vocabulary."""
    return ByteCoder(name)


def encoded(docs: DataFrame, name: str = RANKS) -> DataFrame:
    """doc_id and ids (little-endian unsigned 32-bit integers) of every row of ``docs``.

    Null and empty texts have no ids. Equal texts get equal ids, repeated rows stay, no rows give no
    rows, a null doc_id stays null; columns besides doc_id and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = coder(name).encode(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    rows = docs.select("doc_id", "text")
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(b"").alias("ids")).schema)


def decoded(rows: DataFrame, name: str = RANKS) -> DataFrame:
    """``rows`` (doc_id, ids) with the bytes their ids stand for; null ids stand for none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back = [coder(name).decode(ids or b"") for ids in batch.column(1).to_pylist()]
            columns = [batch.column(0), batch.column(1), pa.array(back, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids", "decoded"])

    rows = rows.select("doc_id", "ids")
    return rows.mapInArrow(run, rows.select("*", F.col("ids").alias("decoded")).schema)
