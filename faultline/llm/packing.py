"""Packing of token sequences by minimum bin slack."""

from __future__ import annotations

import zlib
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import numbered
from faultline.llm.tokens import END_OF_TEXT, encoded
from faultline.session import materialize

CAPACITY = 4096
PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Every document's ids, end id included, cut after each ``capacity`` ids; a written table without texts."""
    end = END_OF_TEXT[vocabulary]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            rows = [
                (doc_id, k, k * capacity, len(part) // 4, zlib.crc32(part))
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(texts, vocabulary, end))
                for k, part in enumerate(ids[i : i + 4 * capacity] for i in range(0, len(ids), 4 * capacity))
            ]
            columns = zip(*rows) if rows else [()] * len(PIECES)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECES.types)], schema=PIECES)

    rows = docs.select("doc_id", "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")
    return materialize(rows.withColumn("_scan", F.monotonically_increasing_id()), "pieces")


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> dict[int, int]:
    """The numbers of each length whose sum is as near to ``room`` as the counts allow.

    Bit s of a whole number tells whether the sum s can be reached. Longer lengths go first, copies
    in doubling lots, and the search ends once the room can be filled.
    """
    reach, every, steps = 1, (1 << room + 1) - 1, []
    for length in reversed(lengths):
        left, lot = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            lot = min(lot, left)
            steps.append((length, lot, reach))
            reach |= reach << length * lot & every
            left, lot = left - lot, 2 * lot
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, lot, before in reversed(steps):
        if not before >> total & 1:
            total -= length * lot
            chosen[length] = chosen.get(length, 0) + lot
    return chosen


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """Bins as (number of each length, times this bin is filled), until every length is used up.

    Each bin takes the longest length left and the fullest combination that fits beside it. The
    same search over the same lengths finds the same bin, so a bin is repeated as long as the counts
    last: the work depends on the number of different lengths, not of documents.
    """
    counts = {length: n for length, n in counts.items() if n}
    lengths, bins = [], []
    for length in counts:
        insort(lengths, length)
    while lengths:
        longest = lengths[-1]
        counts[longest] -= 1
        chosen = fullest(counts, lengths, capacity - longest)
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(counts[length] // n for length, n in chosen.items())
        for length, n in chosen.items():
            counts[length] -= n * times
            if not counts[length]:
                lengths.remove(length)
        bins.append((chosen, times))
    return bins


def _intervals(counts: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (first row number, bin's first sequence, copies a bin, offset, length) in order of row numbers.

    Pieces are numbered by length, so the copies that one kind of bin takes of a length are
    consecutive numbers.
    """
    taken, total = {}, 0
    for length in sorted(counts):
        taken[length] = total
        total += counts[length]
    out, sequence = [], 0
    for chosen, times in plan_bins(counts, capacity):
        offset = 0
        for length, n in chosen.items():
            out.append((taken[length], sequence, n, offset, length))
            taken[length] += n * times
            offset += n * length
        sequence += times
    return np.array(sorted(out), np.int64).reshape(-1, 5)


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Sequence and offset of every piece of every document.

    A null text is the end id alone, a null doc_id stays null, repeated rows are packed each, an
    empty table gives no rows, and other columns are not read. The driver sees the number of pieces
    of each length, at most ``capacity`` numbers, and plans bins from them; tasks look up where the
    plan puts a piece by its number in the order of lengths.
    """
    cut = pieces(docs, vocabulary, capacity)
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    rows = numbered(cut, ["length", "doc_id", "piece", "ids_crc32", "_scan"], "pieces-order")
    plan = cut.sparkSession.sparkContext.broadcast(_intervals(counts, capacity))
    schema = pa.schema([*PIECES, ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, copies, offset, length = plan.value.T
        for batch in batches:
            at = batch.column(len(PIECES)).to_numpy()
            k = np.searchsorted(first, at, side="right") - 1
            nth = at - first[k]
            where = [sequence[k] + nth // copies[k], offset[k] + nth % copies[k] * length[k]]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(PIECES)], *map(pa.array, where)], schema=schema)

    return rows.select(*PIECES.names, "row_no").mapInArrow(
        put, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
