"""Ordered computations per key that stay distributed when one key is huge.

A window ``PARTITION BY key ORDER BY x`` sends every row of a key to one task. Here a key with more
than ``rows_per_bucket`` rows is cut along ``x`` into buckets, the window runs per (key, bucket),
and a small table carries the state of earlier buckets forward. Results do not depend on where the
cuts fall. The cut points are computed once and then fixed as literals, so a retried task sees the
same buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 4_000_000
_STRIDE = 64
_PARTS = 16_384  # by which rows are counted to see whether any key can be hot


def any_hot_key(df: DataFrame, keys: list[str], rows_per_bucket: int) -> bool:
    """Whether a part of the keys, by hash, and so perhaps a key, has more than ``rows_per_bucket`` rows."""
    part = F.pmod(F.xxhash64(*keys), F.lit(_PARTS))
    full = df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_bucket)
    return not full.isEmpty()


def hot_key_cuts(df: DataFrame, keys: list[str], order: str, rows_per_bucket: int) -> DataFrame | None:
    """Cut points of every key holding more than ``rows_per_bucket`` rows; None if there is none.

    There are at most (rows / rows_per_bucket) hot keys and as many cuts in total, which bounds
    the collected table whatever the data looks like. Rows are counted by a hash of their key first: a key can
    only be hot in a part that holds as many rows, so keys are mostly not shuffled to be counted.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(_PARTS))
    full = df.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_bucket)
    parts = [r["_part"] for r in full.collect()]
    if not parts:
        return None
    hot = (
        df.filter(part.isin(parts)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_bucket)
    )
    hot_rows = hot.collect()
    if not hot_rows:
        return None
    spark = df.sparkSession
    hot_keys = spark.createDataFrame(hot_rows, hot.schema)
    grid = -(-max(r["_n"] for r in hot_rows) // rows_per_bucket)
    # a key of n rows keeps ceil(n / rows_per_bucket) - 1 of the grid's cut points
    wanted = F.expr(
        f"transform(sequence(1, cast(least({grid}, ceil(_n / {rows_per_bucket})) as int) - 1), "
        f"i -> element_at(_q, cast(floor(i * {grid} / least({grid}, ceil(_n / {rows_per_bucket}))) as int)))"
    )
    cuts = (
        _null_safe_join(df, F.broadcast(hot_keys), keys, "inner")
        .groupBy(*keys, "_n")
        .agg(F.percentile_approx(order, [i / grid for i in range(1, grid)], max(10_000, grid)).alias("_q"))
        .select(*keys, F.array_sort(F.array_distinct(wanted)).alias("_cuts"))
        .withColumn(
            "_tops", F.expr(f"filter(_cuts, (c, i) -> i % {_STRIDE} = {_STRIDE - 1})")
        )
    )
    return spark.createDataFrame(cuts.collect(), cuts.schema)


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str) -> DataFrame:
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys],
        *[c for c in right.columns if c not in keys],
    )
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def with_buckets(df: DataFrame, order: str, keys: list[str], cuts: DataFrame) -> DataFrame:
    """Add ``_hot`` and ``_bucket``: the number of cut points strictly below the row's value."""
    joined = _null_safe_join(df, F.broadcast(cuts), keys, "left")
    # two-step search: whole strides first, then inside one stride
    coarse = F.expr(f"size(filter(_tops, c -> c < `{order}`))")
    fine = F.expr(f"size(filter(slice(_cuts, _coarse * {_STRIDE} + 1, {_STRIDE}), c -> c < `{order}`))")
    hot = F.col("_cuts").isNotNull()
    return (
        joined.withColumn("_hot", hot)
        .withColumn("_coarse", F.when(hot, coarse).otherwise(0))
        .withColumn("_bucket", F.when(hot, F.col("_coarse") * _STRIDE + fine).otherwise(0))
        .drop("_coarse", "_cuts", "_tops")
    )


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, Column],
    mins: dict[str, Column] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    may_be_hot: bool = True,
) -> DataFrame:
    """Per key, totals (and minima) over all rows with ``order`` <= the row's own value.

    ``may_be_hot=False`` says that no key is hot, so that ``df`` is not read to find out.
    """
    mins = mins or {}
    source = df.select("*", *[c.alias(f"_v_{n}") for n, c in {**sums, **mins}.items()])
    cuts = hot_key_cuts(df, keys, order, rows_per_bucket) if may_be_hot else None
    scratch = [f"_v_{n}" for n in (*sums, *mins)]

    def over(window):
        return [F.sum(f"_v_{n}").over(window).alias(n) for n in sums] + [
            F.min(f"_v_{n}").over(window).alias(n) for n in mins
        ]

    if cuts is None:
        window = (
            Window.partitionBy(*keys)
            .orderBy(order)
            .rangeBetween(Window.unboundedPreceding, Window.currentRow)
        )
        return source.select("*", *over(window)).drop(*scratch)

    bucketed = with_buckets(source, order, keys, cuts)
    window = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(order)
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = bucketed.select("*", *over(window)).drop(*scratch)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        bucketed.filter("_hot")
        .groupBy(*keys, "_bucket")
        .agg(
            *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
            *[F.min(f"_v_{n}").alias(f"_t_{n}") for n in mins],
        )
        .select(
            *keys,
            "_bucket",
            *[F.sum(f"_t_{n}").over(before).alias(f"_c_{n}") for n in sums],
            *[F.min(f"_t_{n}").over(before).alias(f"_c_{n}") for n in mins],
        )
    )
    joined = _null_safe_join(local, F.broadcast(carry), [*keys, "_bucket"], "left")
    combined = {n: F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in sums}
    combined |= {n: F.least(n, f"_c_{n}") for n in mins}
    return joined.withColumns(combined).drop("_hot", "_bucket", *[f"_c_{n}" for n in (*sums, *mins)])


def previous_row(
    df: DataFrame,
    keys: list[str],
    order: str,
    values: list[str],
    ties: list[str] | None = None,
    alias: str = "prev",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Per key, a struct of ``values`` taken from the row just before by (``order``, ``ties``)."""
    ordering = [order, *(ties or [])]
    payload = F.struct(*values)
    cuts = hot_key_cuts(df, keys, order, rows_per_bucket)
    if cuts is None:
        window = Window.partitionBy(*keys).orderBy(*ordering)
        return df.withColumn(alias, F.lag(payload).over(window))
    bucketed = with_buckets(df, order, keys, cuts)
    local = bucketed.withColumn(
        alias, F.lag(payload).over(Window.partitionBy(*keys, "_bucket").orderBy(*ordering))
    )
    carry = (
        bucketed.filter("_hot")
        .groupBy(*keys, "_bucket")
        .agg(F.max_by(payload, F.struct(*ordering)).alias("_last"))
        .select(
            *keys,
            "_bucket",
            F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket")).alias("_carry"),
        )
    )
    return (
        _null_safe_join(local, F.broadcast(carry), [*keys, "_bucket"], "left")
        .withColumn(alias, F.coalesce(F.col(alias), F.col("_carry")))
        .drop("_hot", "_bucket", "_carry")
    )


def nearby_rows(
    df: DataFrame, keys: list[str], order: str, values: list[str], count: int, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Per key, arrays ``before`` (nearest last) and ``after`` (nearest first) of up to ``count`` rows each.

    Entries are structs of ``values``; ``order`` is unique per key. A bucket of a huge key takes a halo of
    ``count`` rows from the buckets on both sides: every bucket that occurs has a row, so ``count`` buckets
    on a side hold enough. Single rows at fixed distances are put together, which is less work than a list
    collected anew for each row.
    """
    payload = F.struct(*values)
    steps = range(1, count + 1)

    def within(rows: DataFrame, partition: list[str]) -> DataFrame:
        window = Window.partitionBy(*partition).orderBy(order)
        beside = rows.select(
            "*",
            *[F.lag(payload, i).over(window).alias(f"_b{i}") for i in steps],
            *[F.lead(payload, i).over(window).alias(f"_a{i}") for i in steps],
        )
        size = {side: sum((F.col(f"{side}{i}").isNotNull().cast("int") for i in steps), F.lit(0)) for side in ("_b", "_a")}
        before = F.slice(F.array(*[f"_b{i}" for i in reversed(steps)]), F.lit(count + 1) - size["_b"], count)
        after = F.slice(F.array(*[f"_a{i}" for i in steps]), F.lit(1), size["_a"])
        return beside.withColumns({"before": before, "after": after}).drop(*[f"{s}{i}" for s in ("_b", "_a") for i in steps])

    cuts = hot_key_cuts(df, keys, order, rows_per_bucket)
    if cuts is None:
        return within(df, keys)
    bucketed = with_buckets(df, order, keys, cuts)
    inside = Window.partitionBy(*keys, "_bucket")
    edges = (
        bucketed.filter("_hot")
        .select(
            *keys, "_bucket", F.struct(F.col(order).alias("_o"), payload.alias("_v")).alias("_e"),
            F.row_number().over(inside.orderBy(order)).alias("_first"),
            F.row_number().over(inside.orderBy(F.desc(order))).alias("_last"),
        )
        .filter((F.col("_first") <= count) | (F.col("_last") <= count))
        .groupBy(*keys, "_bucket")
        .agg(
            F.array_sort(F.collect_list(F.when(F.col("_last") <= count, F.col("_e")))).alias("_ends"),
            F.array_sort(F.collect_list(F.when(F.col("_first") <= count, F.col("_e")))).alias("_begins"),
        )
    )
    sides = Window.partitionBy(*keys).orderBy("_bucket")
    halo = edges.select(
        *keys,
        "_bucket",
        F.flatten(F.collect_list("_ends").over(sides.rowsBetween(-count, -1)))["_v"].alias("_halo_before"),
        F.flatten(F.collect_list("_begins").over(sides.rowsBetween(1, count)))["_v"].alias("_halo_after"),
    )
    joined = _null_safe_join(within(bucketed, [*keys, "_bucket"]), F.broadcast(halo), [*keys, "_bucket"], "left")
    earlier = F.when(F.col("_hot"), F.concat("_halo_before", "before")).otherwise(F.col("before"))
    later = F.when(F.col("_hot"), F.concat("after", "_halo_after")).otherwise(F.col("after"))
    return (
        joined.withColumns({"before": earlier, "after": later})
        .withColumn("before", F.slice("before", F.greatest(F.size("before") - count, F.lit(0)) + 1, count))
        .withColumn("after", F.slice("after", 1, count))
        .drop("_hot", "_bucket", "_halo_before", "_halo_after")
    )
