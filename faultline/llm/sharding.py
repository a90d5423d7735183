"""Reproducible shuffles into shards by a permutation of row numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import numbered, text_of
from faultline.session import materialize

ROUNDS = 8
SEED = 20_240_501


def _whole(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


class Feistel:
    """A pseudo-random permutation of the numbers 0 to ``n`` - 1 as a column expression.

    A number is split into two halves on the smallest near-square grid that holds ``n`` numbers;
    rounds in turn add a hash of one half to the other. A result of ``n`` or more goes through the
    rounds again until it is below ``n`` (cycle walking). The grid has fewer than sqrt(n) + 1
    numbers too many and a walk meets each at most once, so it ends within that many steps; only
    the few rows that need it walk at all.
    """

    def __init__(self, n: int, seed: int = SEED, rounds: int = ROUNDS):
        self.n, self.seed, self.rounds = n, seed, rounds
        self.left = math.isqrt(max(n - 1, 0)) + 1
        self.right = max(1, -(-n // self.left))
        self.spare = self.left * self.right - n

    def _once(self, number: Column, back: bool) -> Column:
        left, right = F.lit(self.left).cast("long"), F.lit(self.right).cast("long")
        sign = -1 if back else 1

        def step(halves: Column, k: Column) -> Column:
            def drift(half: Column, size: Column) -> Column:
                return F.pmod(F.xxhash64(F.lit(self.seed).cast("long"), k, half), size) * sign

            a, b = halves["a"], halves["b"]
            return F.when(
                k % 2 == 0, F.struct(F.pmod(a + drift(b, left), left).alias("a"), b.alias("b"))
            ).otherwise(F.struct(a.alias("a"), F.pmod(b + drift(a, right), right).alias("b")))

        order = range(self.rounds)
        steps = F.array(*(F.lit(k) for k in (reversed(order) if back else order)))
        halves = F.struct(_whole(number, right).alias("a"), F.pmod(number, right).alias("b"))
        return F.aggregate(steps, halves, step, lambda h: h["a"] * right + h["b"])

    def _walked(self, number: Column, back: bool) -> Column:
        first = self._once(number.cast("long"), back)
        if not self.spare:
            return first
        inside = lambda x: x < self.n
        steps = F.sequence(F.lit(1), F.lit(self.spare))
        walk = F.aggregate(steps, first, lambda x, _: F.when(inside(x), x).otherwise(self._once(x, back)))
        return F.when(inside(first), first).otherwise(walk)

    def of(self, number: Column) -> Column:
        return self._walked(number, back=False)

    def back(self, number: Column) -> Column:
        return self._walked(number, back=True)


def placed(numbers: DataFrame, n: int, shards: int, number: str = "row_no", seed: int = SEED) -> DataFrame:
    """``shard`` and ``slot`` of each of the rows numbered 0 to ``n`` - 1: shard sizes differ by one at most."""
    dealt = numbers.withColumn("_place", Feistel(n, seed).of(F.col(number)))
    shard = F.pmod("_place", F.lit(shards).cast("long")).cast("int")
    slot = _whole(F.col("_place"), F.lit(shards).cast("long"))
    return dealt.withColumns({"shard": shard, "slot": slot}).drop("_place")


def row_number_at(shard: Column, slot: Column, n: int, shards: int, seed: int = SEED) -> Column:
    """The row number that ``placed`` put at a shard and slot, computed without any table."""
    return Feistel(n, seed).back(slot.cast("long") * shards + shard.cast("long"))


def shard_documents(docs: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Place of every document under the law ``rows``.

    Row numbers follow doc_id, then content; rows equal in all of that may swap places. A null
    doc_id comes first, a null text has no bytes, repeated rows are all placed, an empty table gives
    none; other columns of ``docs`` are not read. Only ids, sizes and checksums move.
    """
    text = text_of()
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_content"),
        F.monotonically_increasing_id().alias("_scan"),
    )
    narrow = materialize(narrow, "sharding")
    rows = numbered(narrow, ["doc_id", "_content", "size", "_scan"], "sharding-order")
    return placed(rows, narrow.count(), shards, seed=seed).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
