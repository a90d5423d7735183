"""Language identification by hyperdimensional profiles of letter triples."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 1024
SEED = 71
UNKNOWN = "und"
# Labelled rows a language is learned from, about; taken by hash of doc_id.
MAX_ROWS_PER_LANGUAGE = 4_000
_BOUNDARY = 32
_CHUNK = 1 << 20


def _letter_kinds() -> np.ndarray:
    """For every code point: 1 a letter, 2 a mark that belongs to a letter, 0 anything else."""
    kinds = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        category = unicodedata.category(chr(c))[0]
        kinds[c] = 1 if category == "L" else 2 if category == "M" else 0
    return kinds


class Profiler:
    """Turns texts into vectors; one per worker process.

    Every letter has a random vector of +1 and -1, drawn from its code point. A triple of letters is
    bound as twice-rotated first times once-rotated second times third; a text is the sum of its
    triples. Runs of anything but letters and marks are one word boundary, which counts as a letter.
    """

    def __init__(self, dimensions: int = DIMENSIONS, remembered: int = 24_000):
        self.dimensions, self.remembered = dimensions, remembered
        self.kinds = _letter_kinds()
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((remembered, dimensions), np.float32)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 20_000:
                self.letters.clear()
            bits = np.random.default_rng([SEED, code]).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def _vector(self, triple: int) -> np.ndarray:
        a, b, c = (self._letter(triple >> shift & 0x1FFFFF) for shift in (42, 21, 0))
        return np.roll(a, 2) * np.roll(b, 1) * c

    def triples(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Different triples of the whole text and how often each occurs; none for a text without letters."""
        found, counts, last, lettered = [], [], np.array([_BOUNDARY], np.uint64), False
        for i in range(0, len(text), _CHUNK):
            codes = np.frombuffer(text[i : i + _CHUNK].lower().encode("utf-32-le"), "<u4")
            kinds = self.kinds[codes]
            lettered = lettered or bool((kinds == 1).any())
            codes = np.concatenate([last, np.where(kinds > 0, codes, _BOUNDARY).astype(np.uint64)])
            if i + _CHUNK >= len(text):
                codes = np.append(codes, np.uint64(_BOUNDARY))
            again = np.zeros(len(codes), bool)
            again[1:] = (codes[1:] == _BOUNDARY) & (codes[:-1] == _BOUNDARY)
            codes = codes[~again]
            keys, n = np.unique(codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:], return_counts=True)
            found.append(keys)
            counts.append(n)
            last = codes[-2:]
        if not lettered:
            return np.empty(0, np.uint64), np.empty(0, np.int64)
        if len(found) == 1:
            return found[0], counts[0]
        keys, place = np.unique(np.concatenate(found), return_inverse=True)
        return keys, np.bincount(place, np.concatenate(counts)).astype(np.int64)

    def _places(self, keys: list[int]) -> list[int]:
        rows = self.rows
        if len(rows) + len(keys) > self.remembered:
            rows.clear()
        for key in keys:
            if key not in rows:
                rows[key] = len(rows)
                self.vectors[rows[key]] = self._vector(key)
        return [rows[key] for key in keys]

    def profile(self, text: str | None) -> np.ndarray | None:
        """The text's vector at unit length, None for null or a text without letters."""
        keys, counts = self.triples(text or "")
        if not len(keys):
            return None
        total = np.zeros(self.dimensions, np.float32)
        step = self.remembered // 4
        for i in range(0, len(keys), step):
            places = self._places(keys[i : i + step].tolist())
            total += counts[i : i + step].astype(np.float32) @ self.vectors[places]
        return total / max(float(np.linalg.norm(total)), 1e-9)


_profilers: dict[int, Profiler] = {}


def profiler(dimensions: int) -> Profiler:
    if dimensions not in _profilers:
        _profilers[dimensions] = Profiler(dimensions)
    return _profilers[dimensions]


def held_out() -> Column:
    """Rows that are never learned from: crc32 of the id's digits is a multiple of 5, or no id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(True))


def learn(docs: DataFrame, per_language: int = MAX_ROWS_PER_LANGUAGE, dimensions: int = DIMENSIONS) -> dict[str, np.ndarray]:
    """One unit vector a language: the bundle of the profiles of its labelled texts.

    About ``per_language`` rows of each language are read, every one of a smaller language; their
    texts are bundled where they are, and only the sums, one vector a language, reach the driver.
    """
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    slots = 1 << 20
    shares = {r["lang"]: min(slots, max(1, slots * per_language // r["count"])) for r in usable.groupBy("lang").count().collect()}
    if not shares:
        return {}
    share = F.create_map(*(F.lit(x) for pair in shares.items() for x in pair))[F.col("lang")]
    sample = usable.filter(F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(slots)) < share).select("lang", "text")

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        profile = profiler(dimensions).profile
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                vector = profile(text.as_py())
                if vector is not None:
                    sums[lang] = sums.get(lang, 0.0) + vector.astype(np.float64)
        for lang, vector in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * dimensions, "k": np.arange(dimensions), "x": vector})

    parts = sample.hint("rebalance").mapInArrow(bundle, "lang string, k long, x double")
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "k").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r["lang"], np.zeros(dimensions))[r["k"]] = r["x"]
    return {lang: v / max(float(np.linalg.norm(v)), 1e-9) for lang, v in sorted(out.items())}


def identify(docs: DataFrame, prototypes: dict[str, np.ndarray], *keep: str) -> DataFrame:
    """Columns ``keep``, then lang_pred and score, from the text alone.

    The language whose prototype has the largest cosine wins, the first in alphabetical order among
    equals; the score is that cosine, at least 0. Null, empty and letterless texts are ``und`` with
    score 0, as is everything if no language was learned. Repeated rows are judged alike, an empty
    table gives no rows, columns that are not kept are not read.
    """
    languages = list(prototypes)
    matrix = np.array([prototypes[lang] for lang in languages], np.float32)
    kept = docs.select(*keep, F.col("text").alias("_fl_text"))
    schema = kept.drop("_fl_text").schema.add("lang_pred", "string").add("score", "double")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = [], []
            for text in batch.column(len(keep)):
                vector = profiler(matrix.shape[1]).profile(text.as_py()) if languages else None
                if vector is None:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                else:
                    cosines = matrix @ vector
                    best = int(cosines.argmax())
                    names.append(languages[best])
                    scores.append(min(1.0, max(0.0, float(cosines[best]))))
            columns = [*batch.columns[: len(keep)], pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "lang_pred", "score"])

    return kept.mapInArrow(predict, schema)


def identify_documents(docs: DataFrame) -> DataFrame:
    prototypes = learn(docs)
    return identify(docs, prototypes, "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
