"""Connected components of a graph, and roots of a forest, held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import materialize

ROWS_PER_TASK = 100_000


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, for each end (a, b: long) of an edge.

    Rounds of two steps until all links are stars around a smallest node: every node passes the
    smallest of itself and its neighbours on to its larger neighbours, then to its smaller ones
    ("large star, small star"). Paths get shorter by a factor each round. Minima combine before the
    shuffle and the join that follows can be split, so a node with very many neighbours is no
    bottleneck. Each step is a written table with as many files as its links need. No edges give no
    rows.
    """
    links = edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo"))
    links = materialize(links.distinct(), "links")
    tasks = links.count() // ROWS_PER_TASK + 1
    while not _stars(links):
        both = links.select(F.col("hi").alias("n"), F.col("lo").alias("m")).union(links.select("lo", "hi"))
        least = both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("top"))
        large = _written(_hooked(both.filter("m > n"), least, tasks), tasks)
        down = large.select(F.col("hi").alias("n"), F.col("lo").alias("m"))
        least = down.groupBy("n").agg(F.min("m").alias("top"))
        small = _hooked(down, least, tasks).union(large.groupBy("hi").agg(F.min("lo").alias("lo")))
        links = _written(small, tasks)
    roots = links.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return roots.union(links.select("lo", "lo").distinct())


def _written(links: DataFrame, tasks: int) -> DataFrame:
    return materialize(links.distinct().coalesce(tasks), "links")


def _hooked(pairs: DataFrame, least: DataFrame, tasks: int) -> DataFrame:
    """Each neighbour m of n linked to the smallest node that n knows."""
    least = materialize(least.coalesce(tasks), "least")  # both sides are then dealt out alike, and a hot node can be split
    met = pairs.join(least, "n").filter("m <> top")
    return met.select(F.greatest("m", "top").alias("hi"), F.least("m", "top").alias("lo"))


def _stars(links: DataFrame) -> bool:
    """Whether each larger end has one smaller end that is nobody's larger end."""
    ends = links.select(F.col("hi").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(links.select("lo", F.lit(0), F.lit(1)))
    nodes = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | (F.col("up") == 1) & (F.col("down") == 1))).first()[0] == 0


def roots(parents: DataFrame) -> DataFrame:
    """``node`` and its topmost ancestor ``root`` for each row (node, parent: long) of a forest.

    Pointers double: each round, a node that does not point to a root yet takes over the pointer of
    the node it points to. Nodes that are done only serve others, and a round joins on single nodes.
    """
    pointers = parents.select("node", F.col("parent").alias("root"), F.lit(False).alias("done"))
    pointers = materialize(pointers, "pointers")
    tasks = pointers.count() // ROWS_PER_TASK + 1
    while not pointers.filter(~F.col("done")).isEmpty():
        above = pointers.select(F.col("node").alias("root"), F.col("root").alias("next"))
        moved = pointers.filter(~F.col("done")).join(above, "root", "left")
        moved = moved.select("node", F.coalesce("next", "root").alias("root"), F.col("next").isNull().alias("done"))
        pointers = materialize(moved.union(pointers.filter("done")).coalesce(tasks), "pointers")
    return pointers.select("node", "root")
