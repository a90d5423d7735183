"""Exact k nearest neighbours as a distributed join.

The search runs over distinct vectors, so a vector shared by a third of all rows is one entry with a
count. It has two steps.

Sweeps put all vectors in order of their projection on a random direction, cut the order into runs
and compare every run with itself and the two beside it. Projections are never further apart than the
vectors, so a row whose k-th candidate is nearer than both ends of what it was compared with has its
certificate: nothing outside can be closer. Rows without one keep the distance as their bound.

Only those rows are searched in full. Vectors belong to the nearest of a bounded number of top pivots.
The triangle inequality names the cells that can hold anything within the bound, and a row moves to those only.
Cells are cut into blocks of bounded size on the query side and on the data side, so no task holds a whole cell.
A task cuts its block into smaller cells around rows of the block and rules them out in the same way. Blocks are
large, as every pair of blocks is a move of both.
"""

from __future__ import annotations

import math
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import materialize

BLOCK_ROWS = 4_000
DIRECTIONS = 2
TOP_PIVOTS = 1_024
SEED = 42
_SHARES = 12  # a side of the full search is cut into, while blocks are small enough
_WIDE = 16  # times block_rows in a block of the full search, at most
_WIDE_VALUES = 1 << 22
_ASKERS = 1_024
_WAITING = 1 << 20
_RUNS_PER_TASK = 32
_CHUNK = 256
_SLACK = 1e-9
_FOUND = "vec string, rank int, neighbour string, squared_distance double, certified boolean"


def distinct_vectors(df: DataFrame, id_column: str, features: list[str], label: str = "y") -> DataFrame:
    """One row per distinct vector: smallest and largest id, number of copies, copies of class 1."""
    return (
        df.groupBy(*[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(features)])
        .agg(
            F.min(F.col(id_column).cast("string")).alias("vec"),
            F.max(F.col(id_column).cast("string")).alias("last_id"),
            F.count(F.lit(1)).alias("copies"),
            F.count_if(F.col(label) == 1).alias("positives"),
        )
        .select("vec", "last_id", "copies", "positives", _vector(len(features)).alias("x"))
    )


def _vector(width: int) -> Column:
    return F.array(*[F.col(f"_x{i}") for i in range(width)])


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for i in range(a.shape[1]):
        out += np.square(a[:, i, None] - b[None, :, i])
    return out


def _roots(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    """Distances of a few rows of ``a`` at a time to all of ``b``."""
    for at in range(0, len(a), _CHUNK):
        yield slice(at, at + _CHUNK), np.sqrt(_squared(a[at : at + _CHUNK], b))


def _k_smallest(ids: np.ndarray, a: np.ndarray, other: np.ndarray, b: np.ndarray, k: int):
    """Arrays (row of a, place in other, squared distance) of the k nearest others, by distance and then id.

    A product of matrices leaves few candidates; what it can be wrong by is added to the limit, and the
    candidates are measured feature by feature.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    order = np.argsort(other)
    sorted_ids, b = other[order], b[order]
    place = np.minimum(np.searchsorted(sorted_ids, ids), len(other) - 1)
    own = sorted_ids[place] == ids
    size_b = np.square(b).sum(axis=1)
    error = 8 * (a.shape[1] + 8) * np.finfo(float).eps
    for at in range(0, len(a), _CHUNK):
        part, here = a[at : at + _CHUNK], np.flatnonzero(own[at : at + _CHUNK])
        size_a = np.square(part).sum(axis=1)
        rough = size_a[:, None] + size_b - 2 * (part @ b.T)
        rough[here, place[at + here]] = np.inf
        last = min(k, len(b)) - 1
        limit = np.partition(rough, last, axis=1)[:, last] + error * (size_a + size_b.max())
        row, column = np.nonzero((rough <= limit[:, None]) & np.isfinite(rough))
        exact = np.zeros(len(row))
        for i in range(part.shape[1]):
            exact += np.square(part[row, i] - b[column, i])
        row, column, exact = _first_k(row, column, exact, k)
        found.append((at + row, order[column], exact))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _k_within(ids: np.ndarray, a: np.ndarray, reach: np.ndarray, other: np.ndarray, b: np.ndarray, k: int):
    """Like ``_k_smallest``, for rows of a that already know how far their k-th nearest can be.

    The others are sorted into cells around a few of them; a cell is only measured for the rows that its ring
    does not rule out. Rows that come without a reach, or find nearer ones on the way, go on with a tighter one.
    Nothing is found beside a vector with missing numbers, as in ``_k_smallest``.
    """
    found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
    size_a, size_b = np.square(a).sum(axis=1), np.square(b).sum(axis=1)
    if np.isnan(size_b).any():
        return found[0]
    order = np.argsort(other)
    sorted_ids, b, size_b = other[order], b[order], size_b[order]
    place = np.minimum(np.searchsorted(sorted_ids, ids), len(b) - 1)
    own = np.where(sorted_ids[place] == ids, place, -1)
    pivots = b[:: max(1, len(b) // max(1, math.isqrt(len(b)) // 4))]
    cell, radius = np.zeros(len(b), np.int64), np.zeros(len(b))
    for at, d in _roots(b, pivots):
        cell[at], radius[at] = d.argmin(axis=1), d.min(axis=1)
    members = np.split(np.argsort(cell, kind="stable"), np.cumsum(np.bincount(cell, minlength=len(pivots)))[:-1])
    inner = np.array([radius[m].min(initial=np.inf) for m in members])
    outer = np.array([radius[m].max(initial=-np.inf) for m in members])
    error = 8 * (a.shape[1] + 8) * np.finfo(float).eps
    for at in range(0, len(a), _ASKERS):
        part, end = a[at : at + _ASKERS], min(len(a), at + _ASKERS)
        far, to = np.square(reach[at:end]), np.concatenate([d for _, d in _roots(part, pivots)])
        best = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        waiting, full = 0, np.isfinite(far)
        for c in np.argsort(to.min(axis=0), kind="stable"):
            bound = np.sqrt(far) * (1 + _SLACK) + _SLACK
            needs = np.flatnonzero(_in_ring(to[:, c : c + 1], bound, inner[c], outer[c])[:, 0])
            if not len(needs) or not len(members[c]):
                continue
            row, column = [], []
            for near in np.array_split(members[c], -(-len(members[c]) // BLOCK_ROWS)):
                rough = part[needs] @ (-2 * b[near].T)
                rough += size_b[near]
                limit = far[needs] - size_a[at + needs] + error * (size_a[at + needs] + size_b[near].max())
                asker, at_near = np.nonzero(rough <= limit[:, None])
                row.append(needs[asker])
                column.append(near[at_near])
            row, column = np.concatenate(row), np.concatenate(column)
            others = column != own[at + row]
            row, column = row[others], column[others]
            exact = np.zeros(len(row))
            for i in range(part.shape[1]):
                exact += np.square(part[row, i] - b[column, i])
            best.append((row, column, exact))
            waiting += len(row)
            if waiting > _WAITING or not full.all():
                best, waiting = [_first_k(*map(np.concatenate, zip(*best)), k)], 0
                row, _, exact = best[0]
                last = np.flatnonzero(np.bincount(row, minlength=len(part)) >= k)
                far[last] = np.minimum(far[last], exact[np.searchsorted(row, last, "right") - 1])
                full[last] = True
        row, column, exact = _first_k(*map(np.concatenate, zip(*best)), k)
        found.append((at + row, order[column], exact))
    return tuple(np.concatenate(parts) for parts in zip(*found))


def _first_k(row: np.ndarray, column: np.ndarray, exact: np.ndarray, k: int):
    """The k nearest of each row, by distance and then place."""
    by = np.lexsort((column, exact, row))
    row, column, exact = row[by], column[by], exact[by]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], column[kept], exact[kept]


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


class _Run:
    """A stretch of the order along a direction."""

    def __init__(self, rows: pd.DataFrame):
        self.rows, self.x = rows, _stack(rows["x"])
        self.p, self.ids = rows["p"].to_numpy(), rows["vec"].to_numpy()


def _compare_runs(before: _Run | None, run: _Run, after: _Run | None, k: int, least: float, most: float) -> pd.DataFrame:
    """The run's rows with a tighter ``bound``, and ``near`` where nothing outside the three runs can be closer."""
    rows = run.rows
    bound, near = rows["bound"].to_numpy(float).copy(), np.full(len(rows), None, object)
    asks = np.flatnonzero(rows["asks"].to_numpy(bool))
    if len(asks):
        beside = [r for r in (before, run, after) if r is not None]
        others, x = np.concatenate([r.ids for r in beside]), run.x[asks]
        row, place, squared = _k_smallest(run.ids[asks], x, others, np.concatenate([r.x for r in beside]), k)
        starts = np.searchsorted(row, np.arange(len(asks) + 1))
        full = starts[1:] - starts[:-1] == k
        reach = np.full(len(asks), np.inf)
        reach[full] = np.sqrt(squared[starts[1:][full] - 1])
        bound[asks] = np.minimum(bound[asks], reach)
        low = -np.inf if beside[0].p[0] <= least else beside[0].p[0]
        high = np.inf if beside[-1].p[-1] >= most else beside[-1].p[-1]
        # rounding of projections and distances
        slack = _SLACK * (np.where(full, reach, 0) + np.sqrt(np.square(x).sum(axis=1)) + _SLACK)
        certain = (run.p[asks] - low > reach + slack) & (high - run.p[asks] > reach + slack)
        if np.isinf(low) and np.isinf(high):
            certain[:] = True  # all vectors were compared
        for i in np.flatnonzero(certain):
            span = slice(starts[i], starts[i + 1])
            near[asks[i]] = [
                {"neighbour": other, "squared_distance": d} for other, d in zip(others[place[span]], squared[span])
            ]
    return rows[["vec", "x"]].assign(asks=rows["asks"], bound=bound, near=near)


def sweep(rows: DataFrame, n: int, direction: np.ndarray, k: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``rows`` (vec, x, asks, bound) with tighter bounds, and ``near`` for askers that got their certificate."""
    size = max(1, block_rows // 2)
    turned = F.zip_with("x", F.array(*map(F.lit, direction.tolist())), lambda x, u: x * u)
    projected = rows.withColumn("p", F.aggregate(turned, F.lit(0.0), lambda a, b: a + b))
    ends = projected.agg(F.min("p").alias("least"), F.max("p").alias("most")).first()
    # at least four runs a task, as runs at the ends of a task are compared with one neighbour only
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, n // (4 * size)), n // (_RUNS_PER_TASK * size))
    ordered = projected.repartitionByRange(tasks, "p", "vec").sortWithinPartitions("p", "vec")

    def runs(batches: Iterator[pd.DataFrame]) -> Iterator[_Run]:
        waiting = []
        for batch in batches:
            waiting.append(batch)
            if sum(map(len, waiting)) >= size:
                rows = pd.concat(waiting, ignore_index=True)
                whole = len(rows) // size * size
                for at in range(0, whole, size):
                    yield _Run(rows[at : at + size].reset_index(drop=True))
                waiting = [rows[whole:]]
        if sum(map(len, waiting)):
            yield _Run(pd.concat(waiting, ignore_index=True))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = run = None
        for after in runs(batches):
            if run is not None:
                yield _compare_runs(before, run, after, k, ends["least"], ends["most"])
            before, run = run, after
        if run is not None:
            yield _compare_runs(before, run, None, k, ends["least"], ends["most"])

    near = "near array<struct<neighbour: string, squared_distance: double>>"
    return materialize(
        ordered.mapInPandas(compare, f"vec string, x array<double>, asks boolean, bound double, {near}"), "swept"
    )


def nearest(
    vectors: DataFrame,
    k: int,
    wanted: Column | None = None,
    block_rows: int = BLOCK_ROWS,
    top_pivots: int = TOP_PIVOTS,
    directions: int = DIRECTIONS,
) -> DataFrame:
    """(vec, rank, neighbour, squared_distance, certified) for each vector, ranked by distance and then id.

    ``vectors`` holds unique ``vec`` strings and arrays ``x``; ``wanted`` limits who asks, not who
    can be found. ``certified`` rows needed no full search; the result does not depend on it.
    """
    rows = materialize(
        vectors.select(
            "vec", "x", (F.lit(True) if wanted is None else wanted).alias("asks"), F.lit(math.inf).alias("bound")
        ),
        "vectors",
    )
    n = rows.count()
    if n < 2:
        return rows.sparkSession.createDataFrame([], _FOUND)
    width, draw = rows.select(F.size("x")).first()[0], np.random.default_rng(SEED)
    certified = None
    for _ in range(directions):
        direction = draw.normal(size=width)
        swept = sweep(rows, n, direction / np.linalg.norm(direction), k, block_rows)
        part = swept.filter(F.col("near").isNotNull()).select("vec", F.posexplode("near").alias("_rank", "_n"))
        part = part.select(
            "vec",
            (F.col("_rank") + 1).alias("rank"),
            "_n.neighbour",
            "_n.squared_distance",
            F.lit(True).alias("certified"),
        )
        certified = part if certified is None else certified.unionByName(part)
        rows = swept.select("vec", "x", (F.col("asks") & F.col("near").isNull()).alias("asks"), "bound")
        if rows.filter("asks").isEmpty():
            return certified
    rest = _full_search(rows, n, k, block_rows, top_pivots).withColumn("certified", F.lit(False))
    return rest if certified is None else certified.unionByName(rest)


def _full_search(source: DataFrame, n: int, k: int, block_rows: int, top_pivots: int) -> DataFrame:
    """(vec, rank, neighbour, squared_distance) of the rows of a written table that still ask.

    A row travels once to every block of a cell that may hold one of its neighbours. The number of cells and
    the shares that askers are cut into do not grow until blocks are at their bound, so up to there the rows moved
    are a fixed multiple of all rows; inside a block smaller cells rule out the rest.
    """
    width = source.select(F.size("x")).first()[0]
    wide = max(block_rows, min(_WIDE * block_rows, _WIDE_VALUES // max(1, width)))
    size = min(wide, max(block_rows, -(-n // _SHARES)))
    count = max(1, min(top_pivots, -(-n // size)))
    pivots = np.array(
        [r["x"] for r in source.orderBy(F.md5("vec"), "vec").limit(count).select("x").collect()], dtype=float
    )

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _stack(batch["x"])
            top, radius = np.zeros(len(x), "int64"), np.zeros(len(x))
            for at, d in _roots(x, pivots):
                top[at], radius[at] = d.argmin(axis=1), d.min(axis=1)
            yield batch.assign(top=top, top_radius=radius)

    rows_schema = "vec string, x array<double>, asks boolean, bound double, top long, top_radius double"
    placed = materialize(source.mapInPandas(assign, rows_schema), "topped")
    # a row a top pivot
    tops = placed.groupBy("top").agg(
        F.count(F.lit(1)).alias("n"), F.min("top_radius").alias("inner"), F.max("top_radius").alias("outer")
    )
    tops = materialize(tops, "tops")
    inner, outer = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
    for r in tops.collect():
        inner[r["top"]], outer[r["top"]] = r["inner"], r["outer"]

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query with the top cells that may hold one of its k nearest neighbours."""
        for batch in batches:
            x, reach = _stack(batch["x"]), _reach(batch["bound"])
            for at, d in _roots(x, pivots):
                row, top = np.nonzero(_in_ring(d, reach[at], inner, outer))
                yield batch.iloc[at].iloc[row][["vec", "x", "bound"]].assign(top=top.astype("int64"))

    routed = source.filter("asks").select("vec", "x", "bound")
    routed = materialize(routed.mapInPandas(route, "vec string, x array<double>, bound double, top long"), "routed")
    blocks = tops.select("top", _blocks("n", size).alias("_n"))
    shares = materialize(routed.groupBy("top").agg(_blocks(F.count(F.lit(1)), size).alias("_n")), "shares")
    queries = _in_every_block(_in_blocks(routed, "part", "top", shares), "block", "top", blocks)
    data = _in_every_block(_in_blocks(placed.select("vec", "x", "top"), "block", "top", blocks), "part", "top", shares)

    def compare(queries: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(data):
            return pd.DataFrame({"vec": [], "neighbour": [], "squared_distance": []})
        ids, others = queries["vec"].to_numpy(), data["vec"].to_numpy()
        reach = _reach(queries["bound"])
        row, place, squared = _k_within(ids, _stack(queries["x"]), reach, others, _stack(data["x"]), k)
        return pd.DataFrame({"vec": ids[row], "neighbour": others[place], "squared_distance": squared})

    groups = ["top", "block", "part"]
    found = (
        queries.groupBy(*groups)
        .cogroup(data.groupBy(*groups))
        .applyInPandas(compare, "vec string, neighbour string, squared_distance double")
    )
    by_distance = Window.partitionBy("vec").orderBy("squared_distance", "neighbour")
    return (
        found.withColumn("rank", F.row_number().over(by_distance))
        .filter(F.col("rank") <= k)
        .select("vec", "rank", "neighbour", "squared_distance")
    )


def _reach(bound: pd.Series) -> np.ndarray:
    return bound.to_numpy(float) * (1 + _SLACK) + _SLACK


def _in_ring(d: np.ndarray, reach: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """Whether a cell between two radii can hold anything within reach of a row d away from its pivot."""
    slack = reach[:, None] + _SLACK * d
    return (d - outer <= slack) & (inner - d <= slack)


def _blocks(rows, block_rows: int) -> Column:
    rows = F.col(rows) if isinstance(rows, str) else rows
    return F.ceil(rows / block_rows).cast("int")


def _in_blocks(df: DataFrame, alias: str, key: str, counts: DataFrame) -> DataFrame:
    return (
        df.join(counts, key)
        .withColumn(alias, F.pmod(F.xxhash64("vec"), F.col("_n")).cast("int"))
        .drop("_n")
    )


def _in_every_block(df: DataFrame, alias: str, key: str, counts: DataFrame) -> DataFrame:
    return df.join(counts, key).withColumn(alias, F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
