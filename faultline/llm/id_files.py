"""Token ids in binary files of patched frame-of-reference blocks.

A file holds the ids of consecutive documents, cut into blocks of ``BLOCK`` ids regardless of
document ends. Layout, all numbers little-endian:

    magic
    blocks      n u32 | minimum u32 | exceptions u32 | width u8 | packed bits | positions u32 | values u32
    documents   has_id u8 each | doc_id i64 each | ids u64 each
    starts      u64 of each block, counted from the file's beginning
    footer      documents u64 | blocks u64 | ids u64 | offset of documents u64 | offset of starts u64 | magic

A block stores each id less its minimum in as many bits as the ``PERCENTILE`` of these differences
needs; larger ones are exceptions, with their position and whole value. Since the starts of blocks
and the lengths of documents are known, any range of ids is read without the blocks before it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as stores
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.tokens import END_OF_TEXT, encoded
from faultline.session import materialize, scratch

MAGIC = b"PFORIDS1"
BLOCK = 8192
PERCENTILE = 95
_HEAD = struct.Struct("<IIIB")
_FOOTER = struct.Struct("<QQQQQ8s")


def pack_block(ids: np.ndarray) -> bytes:
    """One block of at least one id, each below 2**32."""
    low = int(ids.min())
    gaps = (ids.astype(np.int64) - low).astype(np.uint32)
    rank = -(-(len(gaps) - 1) * PERCENTILE // 100)
    width = int(np.partition(gaps, rank)[rank]).bit_length()
    odd = np.flatnonzero(gaps >> width) if width < 32 else np.empty(0, np.int64)
    kept = gaps & np.uint32((1 << width) - 1)
    bits = np.unpackbits(kept.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, count=width, bitorder="little")
    packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    head = _HEAD.pack(len(ids), low, len(odd), width)
    return head + packed + odd.astype("<u4").tobytes() + ids[odd].astype("<u4").tobytes()


def unpack_block(data: bytes) -> np.ndarray:
    n, low, exceptions, width = _HEAD.unpack_from(data)
    size, at = (n * width + 7) // 8, _HEAD.size
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little")
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :width] = bits.reshape(n, width)
    ids = np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel() + np.uint32(low)
    at += size
    odd = np.frombuffer(data, "<u4", exceptions, at)
    ids[odd] = np.frombuffer(data, "<u4", exceptions, at + 4 * exceptions)
    return ids


class IdWriter:
    """Writes documents to a stream; keeps one block and the list of documents in memory."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.waiting, self.n_waiting = [], 0
        self.doc_ids, self.lengths, self.starts = [], [], []
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _block(self, ids: np.ndarray) -> None:
        self.starts.append(self.at)
        self._put(pack_block(ids))

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids) // 4)
        self.waiting.append(ids)
        self.n_waiting += len(ids) // 4
        if self.n_waiting >= BLOCK:
            ready = np.frombuffer(b"".join(self.waiting), "<u4")
            whole = len(ready) // BLOCK * BLOCK
            for i in range(0, whole, BLOCK):
                self._block(ready[i : i + BLOCK])
            self.waiting, self.n_waiting = [ready[whole:].tobytes()], len(ready) - whole

    def close(self) -> None:
        if self.n_waiting:
            self._block(np.frombuffer(b"".join(self.waiting), "<u4"))
        documents = self.at
        self._put(np.array([i is not None for i in self.doc_ids], np.uint8).tobytes())
        self._put(np.array([i or 0 for i in self.doc_ids], "<i8").tobytes())
        self._put(np.array(self.lengths, "<u8").tobytes())
        starts = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        counts = len(self.doc_ids), len(self.starts), sum(self.lengths)
        self._put(_FOOTER.pack(*counts, documents, starts, MAGIC))


class IdReader:
    """Reads a file through a random-access stream: the lists first, blocks when asked for."""

    def __init__(self, source):
        self.source = source
        tail = self._get(source.size() - _FOOTER.size, _FOOTER.size)
        n_docs, n_blocks, self.n_ids, documents, starts, magic = _FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError("not a file of token ids")
        table = self._get(documents, 17 * n_docs)
        known = np.frombuffer(table, np.uint8, n_docs)
        ids = np.frombuffer(table, "<i8", n_docs, n_docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known)]
        self.lengths = np.frombuffer(table, "<u8", n_docs, 9 * n_docs).astype(np.int64)
        self.starts = [*np.frombuffer(self._get(starts, 8 * n_blocks), "<u8").tolist(), documents]

    def _get(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def block(self, k: int) -> np.ndarray:
        return unpack_block(self._get(self.starts[k], self.starts[k + 1] - self.starts[k]))

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at ``start`` up to ``stop`` of the file, from their blocks alone."""
        if start >= stop:
            return np.empty(0, "<u4")
        first, last = start // BLOCK, (stop - 1) // BLOCK
        whole = np.concatenate([self.block(k) for k in range(first, last + 1)])
        return whole[start - first * BLOCK : stop - first * BLOCK]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """doc_id, start within the file, number of ids and their crc32, block after block."""
        ends = np.cumsum(self.lengths)
        block, loaded, at = np.empty(0, "<u4"), -1, 0
        for doc_id, end in zip(self.doc_ids, ends.tolist()):
            start, crc = at, 0
            while at < end:
                if at // BLOCK != loaded:
                    loaded = at // BLOCK
                    block = self.block(loaded)
                stop = min(end, (loaded + 1) * BLOCK)
                crc = zlib.crc32(block[at - loaded * BLOCK : stop - loaded * BLOCK].tobytes(), crc)
                at = stop
            yield doc_id, start, end - start, crc


def write_ids(docs: DataFrame, folder: str, vocabulary: str) -> DataFrame:
    """Encode and write every document in ascending doc_id order; one row per file.

    Documents are dealt out by ranges of doc_id, so file k holds smaller ids than file k + 1; equal
    ids follow their text's hash, and rows equal in both may be dealt anywhere between. Null ids
    come first, a null text has the end id alone, other columns are not read, and an empty table
    writes no file. A file gets its name when it is complete: a repeated task replaces it by the
    same bytes.
    """
    order = ["doc_id", "_content", "_scan"]
    keyed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_content"), F.monotonically_increasing_id().alias("_scan"))
    sorted_docs = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    end = END_OF_TEXT[vocabulary]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = stores.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        k = TaskContext.get().partitionId()
        name, hidden = f"{base}/ids-{k:06d}.pfor", f"{base}/.ids-{k:06d}-{uuid.uuid4().hex}"
        with store.open_output_stream(hidden) as out:
            writer = IdWriter(out)
            for batch in batches:
                texts = (t.as_py() for t in batch.column(1))
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoded(texts, vocabulary, end)):
                    writer.add(doc_id, ids)
            writer.close()
        if not writer.doc_ids:
            store.delete_file(hidden)
            return
        store.move(hidden, name)
        yield pa.RecordBatch.from_pydict(
            {"part": [k], "name": [f"ids-{k:06d}.pfor"], "n_docs": [len(writer.doc_ids)], "n_ids": [sum(writer.lengths)]},
            pa.schema([("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]),
        )

    files = sorted_docs.mapInArrow(write, "part long, name string, n_docs long, n_ids long")
    return materialize(files, "id-files")


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start in the whole corpus, n_tokens and ids_crc32 of every document, from the files."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    listed = files.select("name", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    listed = listed.repartition(max(1, files.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = stores.FileSystem.from_uri(folder)
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with store.open_input_file(f"{base}/{name}") as source:
                    rows = [(i, start + at, n, crc) for i, at, n, crc in IdReader(source).documents()]
                for i in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000]), schema.types)], schema=schema)

    return listed.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def store_ids(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """Write all documents' ids to files below ``folder`` and return what the files hold."""
    folder = folder or scratch(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, vocabulary), folder)
