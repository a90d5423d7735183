"""Fill-in-the-middle: content-defined chunks with remembered summaries say where a text's lines end."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import text_of

WINDOW = 16  # bytes the rolling hash sees
CUT_BITS = 9  # a chunk ends where so many bits are zero: 512 bytes on average
LONGEST_CHUNK = 4096
STEP = 1 << 20  # bytes hashed at once
REMEMBERED_BYTES = 48 << 20
_GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)


@dataclass(frozen=True)
class Infill:
    """What decides the cuts and the form of a document.

    Of each 100 documents ``rate`` are transformed, of those ``suffix_first`` in the form spm.
    """

    seed: str = "7"
    rate: int = 100
    suffix_first: int = 50
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """A hash of the last WINDOW bytes at every byte, by doubling the window."""
    value, width = _GEAR[data], 1
    while width < WINDOW:
        value[width:] = value[width:] + (value[:-width] << np.uint32(width))
        width *= 2
    return value


def chunk_ends(data: np.ndarray) -> list[int]:
    """Where the chunks of a text end; only the bytes shortly before decide, or the longest length."""
    found = []
    for start in range(0, len(data), STEP):
        seen = max(start - WINDOW + 1, 0)
        value = rolling_hash(data[seen : start + STEP])[start - seen :]
        found.append(np.flatnonzero(value >> np.uint32(32 - CUT_BITS) == 0) + start + 1)
    ends, last = [], 0
    for end in [*np.concatenate(found).tolist(), len(data)] if found else []:
        ends.extend(range(last + LONGEST_CHUNK, end, LONGEST_CHUNK))
        if end > last:
            ends.append(end)
        last = end
    return ends


class Summary(NamedTuple):
    """What a text needs to know of a chunk; characters count where they begin."""

    chars: int
    breaks: list[int]  # characters up to and with each line end
    marked: bool  # holds a mark
    head: bytes  # its ends, where a mark may run from one chunk into the next
    tail: bytes


class LineIndex:
    """Line ends and characters of texts, put together from the summaries of their chunks.

    Summaries are found by a hash of the chunk and used only if its content is the same.
    """

    def __init__(self, marks: tuple[str, ...], remembered: int = REMEMBERED_BYTES):
        self.mark = re.compile(b"|".join(re.escape(m.encode()) for m in marks))
        self.overlap = max(len(m.encode()) for m in marks) - 1
        self.remembered, self.held = remembered, 0
        self.known: dict[int, tuple[bytes, Summary]] = {}
        self.older: dict[int, tuple[bytes, Summary]] = {}

    def _summarize(self, chunk: bytes) -> Summary:
        data = np.frombuffer(chunk, np.uint8)
        begins = np.cumsum((data & 0xC0) != 0x80)
        edge = self.overlap
        return Summary(
            int(begins[-1]), begins[data == 10].tolist(), self.mark.search(chunk) is not None,
            chunk[:edge], chunk[-edge:] if edge else b"",
        )

    def summary(self, chunk: bytes) -> Summary:
        key = xxhash.xxh3_64_intdigest(chunk)
        entry = self.known.get(key)
        if entry is None or entry[0] != chunk:
            entry = self.older.get(key)
            if entry is None or entry[0] != chunk:
                entry = (chunk, self._summarize(chunk))
            if self.held > self.remembered:
                self.older, self.known, self.held = self.known, {}, 0
            self.known[key] = entry
            self.held += len(chunk) + 8 * len(entry[1].breaks) + 200
        return entry[1]

    def read(self, text: str) -> TextLines:
        raw = text.encode()
        ends = chunk_ends(np.frombuffer(raw, np.uint8))
        parts = [self.summary(raw[a:b]) for a, b in zip([0, *ends], ends)]
        marked, carry = any(p.marked for p in parts), b""
        for p in parts:
            if marked or not self.overlap:
                break
            marked = bool(carry) and self.mark.search(carry + p.head) is not None
            carry = (carry + p.tail)[-self.overlap :]
        return TextLines(parts, raw.endswith(b"\n") or not raw, marked)


class TextLines:
    def __init__(self, parts: list[Summary], closed: bool, marked: bool):
        self.parts, self.marked = parts, marked
        self.breaks = list(accumulate(len(p.breaks) for p in parts))
        self.chars = list(accumulate((p.chars for p in parts), initial=0))
        self.ended = self.breaks[-1] if parts else 0
        self.lines = self.ended + (not closed)

    def chars_before(self, line: int) -> int:
        """Characters of the first ``line`` lines."""
        if line > self.ended or not line:
            return self.chars[-1] if line else 0
        part = bisect_left(self.breaks, line)
        inside = self.parts[part].breaks
        return self.chars[part] + inside[line - 1 - (self.breaks[part] - len(inside))]


@cache
def line_index(marks: tuple[str, ...]) -> LineIndex:
    """One index per worker process."""
    return LineIndex(marks)


def _draws(settings: Infill) -> list[Column]:
    """The first four 8-digit groups of the digest of seed and doc_id."""
    name = F.concat(F.lit(f"{settings.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    digest = F.sha2(name.cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def line_cuts(docs: DataFrame, settings: Infill | None = None) -> DataFrame:
    """doc_id, text, n (lines), marked, prefix_chars, middle_chars and the draws h3 and h4 of every row.

    A line is up to and with its line end, or the rest of the text. The prefix ends after the
    smaller of h1 % (n + 1) and h2 % (n + 1) lines and the middle after the larger.
    """
    settings = settings or Infill()
    draws = [d.alias(f"h{k + 1}") for k, d in enumerate(_draws(settings))]
    rows = docs.select("doc_id", text_of().alias("text"), *draws)
    counts = [F.lit(0).cast("long").alias(c) for c in ("n", "prefix_chars", "middle_chars")]
    schema = rows.select("doc_id", "text", *counts, F.lit(False).alias("marked"), "h3", "h4").schema
    marks = settings.marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = line_index(marks)
        for batch in batches:
            found = []
            for text, h1, h2 in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3))):
                lines = index.read(text)
                a, b = sorted((h1 % (lines.lines + 1), h2 % (lines.lines + 1)))
                first = lines.chars_before(a)
                found.append((lines.lines, first, lines.chars_before(b) - first, lines.marked))
            n, prefix, middle, marked = zip(*found) if found else ((), (), (), ())
            numbers = [pa.array(v, pa.int64()) for v in (n, prefix, middle)]
            columns = [batch.column(0), batch.column(1), *numbers, pa.array(marked, pa.bool_()), batch.column(4), batch.column(5)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return rows.mapInArrow(run, schema)


def fill_in_middle(docs: DataFrame, settings: Infill | None = None) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and output of every row of ``docs``.

    A text that is empty (null counts as empty) or holds one of the marks stays plain, with null in
    the two counts. Rows that repeat a doc_id and its text come out alike; a null doc_id draws like
    an empty one; no rows give no rows; columns besides doc_id and text are not read.
    """
    settings = settings or Infill()
    rows = line_cuts(docs, settings)
    plain = (F.col("text") == "") | F.col("marked") | (F.col("h3") % 100 >= settings.rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < settings.suffix_first, "spm").otherwise("psm")
    rows = rows.withColumn("form", form)
    first = F.substr("text", F.lit(1), F.col("prefix_chars"))
    middle = F.substr("text", F.col("prefix_chars") + 1, F.col("middle_chars"))
    last = F.substr("text", F.col("prefix_chars") + F.col("middle_chars") + 1)
    mark_p, mark_s, mark_m = map(F.lit, settings.marks)
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "spm", F.concat(mark_s, last, mark_p, first, mark_m, middle))
        .otherwise(F.concat(mark_p, first, mark_s, last, mark_m, middle))
    )
    counts = [F.when(F.col("form") != "plain", F.col(c)).alias(c) for c in ("prefix_chars", "middle_chars")]
    return rows.select("doc_id", "n", "form", *counts, output.alias("output"))


def restored(output: Column, form: Column, settings: Infill | None = None) -> Column:
    """The text that an output of ``fill_in_middle`` was made of; no text that was cut holds a mark."""
    settings = settings or Infill()

    def after(mark: str) -> Column:
        return F.instr(output, F.lit(mark)).cast("int") + len(mark)

    def between(mark: str, following: str) -> Column:
        return F.substr(output, after(mark), F.instr(output, F.lit(following)) - after(mark))

    first, last, middle = settings.marks
    end = F.substr(output, after(middle))
    psm = F.concat(between(first, last), end, between(last, middle))
    spm = F.concat(between(first, middle), end, between(last, first))
    return F.when(form == "plain", output).when(form == "spm", spm).otherwise(psm)
