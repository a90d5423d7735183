"""Which lines of a text are kept, new or gone against the text before it: one Arrow-batched UDF per pair."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 0-based first lines on both sides; -1 on the side a run is not part of
RUN = T.StructType().add("after_start", "integer").add("before_start", "integer").add("length", "integer")


def text_lines(text: str | None) -> list[str]:
    """Lines between line feeds; a line feed at the end begins no further line."""
    lines = (text or "").split("\n")
    return lines[:-1] if lines[-1] == "" else lines


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest part of pairs, sorted by their first numbers, whose second numbers rise too."""
    ends, last, previous = [], [], []
    for i, (_, b) in enumerate(pairs):
        at = bisect_left(ends, b)
        previous.append(last[at - 1] if at else -1)
        if at == len(ends):
            ends.append(b)
            last.append(i)
        else:
            ends[at], last[at] = b, i
    chain, i = [], last[-1] if last else -1
    while i >= 0:
        chain.append(pairs[i])
        i = previous[i]
    return chain[::-1]


def _anchors(before, after, stretch) -> list[tuple[int, int]]:
    """Kept lines of a stretch: those found once on both sides, else each line's n-th places on both sides."""
    b0, b1, a0, a1 = stretch
    places: dict[str, tuple[list[int], list[int]]] = {}
    for b in range(b0, b1):
        places.setdefault(before[b], ([], []))[0].append(b)
    for a in range(a0, a1):
        if after[a] in places:
            places[after[a]][1].append(a)
    once = [(a[0], b[0]) for b, a in places.values() if len(a) == len(b) == 1]
    return _rising(sorted(once or (p for b, a in places.values() for p in zip(a, b))))


def kept_lines(before: list[str], after: list[str]) -> list[tuple[int, int]]:
    """(after, before) places of kept lines, rising on both sides.

    Common ends are kept; between them lines that stand once on both sides hold the rest in place, and the
    stretches between those are matched the same way. A stretch without such lines pairs equal lines in
    order and ends there, so the work follows the lines, not their product.
    """
    kept, open_ = [], [(0, len(before), 0, len(after))]
    while open_:
        b0, b1, a0, a1 = open_.pop()
        while b0 < b1 and a0 < a1 and before[b0] == after[a0]:
            kept.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while b0 < b1 and a0 < a1 and before[b1 - 1] == after[a1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            kept.append((a1, b1))
        found = _anchors(before, after, (b0, b1, a0, a1)) if b0 < b1 and a0 < a1 else []
        kept.extend(found)
        for (a, b), (c, d) in zip([(a0 - 1, b0 - 1), *found], [*found, (a1, b1)]) if found else ():
            if b + 1 < d and a + 1 < c:
                open_.append((b + 1, d, a + 1, c))
    return sorted(kept)


def line_runs_of(before: str | None, after: str | None) -> list[tuple[int, int, int]]:
    """Runs of kept, new and gone lines in the order of ``RUN``."""
    old, new = text_lines(before), text_lines(after)
    runs: list[list[int]] = []
    a = b = 0
    for x, y in [*kept_lines(old, new), (len(new), len(old))]:
        if a < x:
            runs.append([a, -1, x - a])
        if b < y:
            runs.append([-1, b, y - b])
        if x < len(new) and y < len(old):
            if a == x and b == y and runs and runs[-1][0] >= 0 and runs[-1][1] >= 0:
                runs[-1][2] += 1
            else:
                runs.append([x, y, 1])
        a, b = x + 1, y + 1
    return [tuple(r) for r in runs]


def line_runs(before: str, after: str) -> Column:
    """Array of ``RUN`` from the text before (null: none) to the text after."""

    @F.pandas_udf(T.ArrayType(RUN))
    def runs(olds: pd.Series, news: pd.Series) -> pd.Series:
        return pd.Series([
            [dict(zip(RUN.names, run)) for run in line_runs_of(old, new)] for old, new in zip(olds, news)
        ], dtype=object)

    return runs(F.col(before), F.col(after))
