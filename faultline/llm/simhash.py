"""Near-duplicates by SimHash fingerprints, compared tile by tile."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import join_groups
from faultline.llm.components import components
from faultline.session import materialize

SHINGLE = 3
HASH_SEED = 42
RADIUS = 2
TILE = 16_384
SUBTILE = 64
PARTS = 8  # bytes of a fingerprint, whose population counts place it


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The whole text's fingerprint; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: lower-cases A-Z only, splits at ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(line, HASH_SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1]
        digest = xxhash.xxh64_intdigest
        spans = zip(starts.tolist(), ends[size - 1 :].tolist())
        hashes = np.fromiter((digest(line[a:b], HASH_SEED) for a, b in spans), np.uint64, len(starts))
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<u8")[0])


def fingerprints(docs: DataFrame, *more) -> DataFrame:
    """doc_id, further columns and the signed 64-bit ``fp`` of every row, a written table without texts."""
    rows = docs.select("doc_id", *more, F.col("text").alias("_fl_text"))
    schema = rows.drop("_fl_text").schema.add("fp", "long")
    names = schema.names

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], fps], names)

    return materialize(rows.mapInArrow(compute, schema), "fingerprints")


def counts_of(fps: np.ndarray) -> np.ndarray:
    """Population counts of the bytes of each fingerprint."""
    return np.bitwise_count(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, PARTS))


def cell_of(counts: np.ndarray) -> np.ndarray:
    """One number for the byte counts, in base 16 so that adding steps never carries."""
    return (counts.astype(np.int64) << (4 * np.arange(PARTS)[::-1])).sum(axis=1)


def near_steps(radius: int) -> list[int]:
    """Differences between cells whose counts differ by up to ``radius`` in all, one of each opposite pair."""
    found = {(0,) * PARTS}
    for _ in range(radius):
        found |= {s[:i] + (s[i] + d,) + s[i + 1 :] for s in found for i in range(PARTS) for d in (-1, 1)}
    numbers = {sum(x << 4 * (PARTS - 1 - i) for i, x in enumerate(s)) for s in found}
    return sorted(n for n in numbers if n >= 0)


def tiles_of(distinct: DataFrame, size: int = TILE) -> DataFrame:
    """Tiles of up to ``size`` fingerprints in order of their byte counts, with the cells each tile has."""
    byte = lambda i: F.bit_count(F.shiftrightunsigned("fp", 8 * i).bitwiseAND(F.lit(255)))
    cell = sum(F.shiftleft(byte(i).cast("long"), 4 * (PARTS - 1 - i)) for i in range(PARTS))
    ordered = distinct.select("fp", cell.alias("cell"))
    ordered = ordered.repartitionByRange("cell", "fp").sortWithinPartitions("cell", "fp").select("fp")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, waiting = TaskContext.get().partitionId() << 32, np.empty(0, np.int64)

        def tile(fps: np.ndarray) -> pa.RecordBatch:
            cells = np.unique(cell_of(counts_of(fps)))
            columns = [pa.array([k]), pa.array([fps.astype("<i8").tobytes()]), pa.array([cells.tolist()], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["tile", "fps", "cells"])

        for batch in batches:
            waiting = np.concatenate([waiting, batch.column(0).to_numpy()])
            while len(waiting) >= size:
                yield tile(waiting[:size])
                waiting, k = waiting[size:], k + 1
        if len(waiting):
            yield tile(waiting)

    return materialize(ordered.mapInArrow(cut, "tile long, fps binary, cells array<long>"), "tiles")


def tile_pairs(tiles: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Pairs (a, b) of tiles that have cells near enough to hold linked fingerprints; a tile pairs with itself."""
    cells = tiles.select("tile", F.explode("cells").alias("cell"))
    steps = F.array(*(F.lit(s).cast("long") for s in near_steps(radius)))
    reach = cells.select(F.col("tile").alias("other"), F.explode(F.transform(steps, lambda s: F.col("cell") + s)).alias("cell"))
    met = reach.join(cells, "cell").select(F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
    return materialize(met.distinct(), "tile-pairs")


class _Groups:
    """Union-find over the places of one comparison, with labels ready for numpy."""

    def __init__(self, n: int):
        self.labels = np.arange(n)

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        x, y = self.labels[x], self.labels[y]
        while True:
            apart = x != y
            if not apart.any():
                return
            x, y = x[apart], y[apart]
            np.minimum.at(self.labels, np.maximum(x, y), np.minimum(x, y))
            while True:
                shorter = self.labels[self.labels]
                if (shorter == self.labels).all():
                    break
                self.labels = shorter
            x, y = self.labels[x], self.labels[y]


def _boxes(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Subtiles padded with their last fingerprint, and the least and largest counts in each."""
    padded = np.concatenate([fps, np.repeat(fps[-1:], -len(fps) % SUBTILE)])
    counts = counts_of(padded).astype(np.int16).reshape(-1, SUBTILE, PARTS)
    return padded.reshape(-1, SUBTILE), counts.min(axis=1), counts.max(axis=1)


def linked(a: np.ndarray, b: np.ndarray, same: bool, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever fingerprints of two tiles are within ``radius`` bits, at most one a fingerprint.

    Subtiles whose counts are further apart are skipped; the others are compared in full, by
    exclusive-or and bit count. Pairs already connected are not linked again.
    """
    tile_a, low_a, high_a = _boxes(a)
    tile_b, low_b, high_b = _boxes(b)
    apart = np.zeros((len(tile_a), len(tile_b)), np.int16)
    for k in range(PARTS):
        gap = np.maximum(low_b[None, :, k] - high_a[:, None, k], low_a[:, None, k] - high_b[None, :, k])
        apart += np.maximum(gap, 0)
    if same:
        apart[np.tril_indices(len(tile_a), -1)] = radius + 1
    i, j = np.nonzero(apart <= radius)
    every = a if same else np.concatenate([a, b])
    groups, base = _Groups(len(every)), 0 if same else len(a)
    for s in range(0, len(i), 64):
        p, q = i[s : s + 64], j[s : s + 64]
        differing = np.bitwise_count(tile_a[p][:, :, None] ^ tile_b[q][:, None, :])
        k, x, y = np.nonzero(differing <= radius)
        if len(k):
            x = np.minimum(p[k] * SUBTILE + x, len(a) - 1)
            y = np.minimum(q[k] * SUBTILE + y, len(b) - 1) + base
            groups.join(x, y)
    moved = np.flatnonzero(groups.labels != np.arange(len(every)))
    return every[moved], every[groups.labels[moved]]


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all those within ``radius`` bits."""
    tiles = tiles_of(distinct, tile)
    pairs = tile_pairs(tiles, radius)
    side = lambda name: tiles.select(F.col("tile").alias(name), F.col("fps").alias(f"fps_{name}"))
    loaded = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "fps_a", "fps_b")
    spread = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    loaded = loaded.repartition(max(1, min(pairs.count(), 2 * spread)))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                ends = linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), a == b, radius)
                yield pa.RecordBatch.from_arrays([pa.array(e.view(np.int64)) for e in ends], ["a", "b"])

    return materialize(loaded.mapInArrow(compare, "a long, b long"), "near-links")


def near_groups(rows: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """``rows`` (a written table with doc_id and fp) with the ``root`` of their component and its ``component_id``.

    Equal fingerprints are one node, so copies are neither compared nor linked one by one.
    """
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n_rows"))
    distinct = materialize(distinct, "distinct-fingerprints")
    roots = components(links(distinct, radius, tile))
    members = materialize(distinct.join(roots.withColumnRenamed("node", "fp"), "fp"), "near-members")
    tops = members.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count(F.lit(1)).alias("n_nodes"))
    named = join_groups(members, materialize(tops, "near-tops"), "root", "n_nodes")
    classes = distinct.join(named.select("fp", "root", "component_id"), "fp", "left").select(
        "fp",
        "n_rows",
        F.coalesce("root", "fp").alias("root"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    return join_groups(rows, materialize(classes, "near-classes"), "fp", "n_rows")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint and component_id of every document.

    A null text has no words, as an empty one; texts without words share the fingerprint zero and
    are linked like any other. Repeated rows are members of the same component each; a component of
    rows without doc_id has no component_id; an empty table gives no rows; other columns are not
    read.
    """
    found = near_groups(fingerprints(docs))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
