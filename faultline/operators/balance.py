"""Evening out the classes of a training set: minority oversampling, then Tomek-link removal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline import schema
from faultline.operators.neighbours import BLOCK_ROWS, distinct_vectors, nearest
from faultline.operators.sampling import with_part
from faultline.session import materialize


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) fixed by its arguments."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / float(1 << 52)


def oversample(
    df: DataFrame,
    id_column: str,
    features: list[str],
    k: int = 5,
    seed: int = schema.SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Synthetic minority rows up to class parity, as (id, y, features), original rows included.

    Each synthetic row lies between a minority row and one of its k nearest minority neighbours.
    Neighbour and position follow from hashes, so the result does not depend on partitioning.
    """
    rows = materialize(
        df.select(
            F.col(id_column).cast("string").alias("id"),
            F.col("y").cast("int").alias("y"),
            *[F.col(c).cast("double").alias(c) for c in features],
        ),
        "rows",
    )
    sizes = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if len(sizes) < 2 or len(set(sizes.values())) == 1:
        return rows
    minority = min(sizes, key=sizes.get)
    small, missing = sizes[minority], max(sizes.values()) - sizes[minority]
    if small < 2:
        raise ValueError("oversampling needs at least two rows of the smaller class")
    k = min(k, small - 1)

    members = rows.filter(F.col("y") == minority)
    vectors = materialize(distinct_vectors(members, "id", features), "minority")
    found = nearest(vectors, k, block_rows=block_rows).join(
        vectors.select(F.col("vec").alias("neighbour"), F.col("x").alias("nx"), F.col("copies").alias("nc")),
        "neighbour",
    )
    listed = found.groupBy("vec").agg(
        F.array_sort(F.collect_list(F.struct("rank", "nx", "nc"))).alias("near")  # at most k entries
    )
    shapes = vectors.join(listed, "vec", "left").select(
        "copies", F.col("x").alias("vx"), F.coalesce("near", F.array().cast(listed.schema["near"].dataType)).alias("near"),
        *[F.element_at("x", i + 1).alias(f"_x{i}") for i in range(len(features))],
    )
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"_x{i}") for i, c in enumerate(features)])
    each, extra = divmod(missing, small)
    counted = with_part(members, "y", "id", [F.lit(extra)], "_late", seed)
    copies = F.lit(each) + F.when(F.col("_late") == 0, 1).otherwise(0)
    drawn = (
        counted.withColumn("_copies", copies)
        .filter(F.col("_copies") > 0)
        .join(shapes, on)
        .withColumn("_j", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
        .withColumn("_pick", F.floor(_uniform(F.lit(seed), F.lit("pick"), F.col("id"), F.col("_j")) * k).cast("int"))
        .withColumn("_u", _uniform(F.lit(seed), F.lit("u"), F.col("id"), F.col("_j")))
    )
    # copies of the own vector are the nearest neighbours; then the listed vectors with their copies
    target = F.expr(
        "aggregate(near, named_struct('left', _pick - cast(copies - 1 as int), 'x', "
        "if(_pick < copies - 1, vx, cast(null as array<double>))), (a, e) -> named_struct("
        "'left', a.left - cast(e.nc as int), 'x', coalesce(a.x, if(a.left < e.nc, e.nx, cast(null as array<double>)))), "
        "a -> coalesce(a.x, vx))"
    )
    synthetic = drawn.withColumn("_to", target).select(
        F.concat("id", F.lit("#"), F.col("_j")).alias("id"),
        F.lit(minority).alias("y"),
        *[
            (F.col(c) + F.col("_u") * (F.element_at("_to", i + 1) - F.col(c))).alias(c)
            for i, c in enumerate(features)
        ],
    )
    return rows.unionByName(synthetic)


def tomek_links(
    df: DataFrame, id_column: str, features: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Pairs (id, partner) of opposite class that are each other's nearest neighbour, id < partner.

    Nearest is by distance; among copies of one vector the own class comes first; then the id.
    """
    vectors = materialize(distinct_vectors(df, id_column, features), "vectors")
    single = F.col("copies") == 1
    # copies of a vector are nearest to each other: a link needs exactly one row of each class
    twins = vectors.filter((F.col("copies") == 2) & (F.col("positives") == 1)).select(
        F.col("vec").alias("id"), F.col("last_id").alias("partner")
    )
    found = nearest(vectors, 1, wanted=single, block_rows=block_rows).select("vec", "neighbour")
    classes = vectors.filter(single).select("vec", "positives")
    forward = found.join(classes, "vec").select(
        F.col("vec").alias("id"), F.col("neighbour").alias("partner"), F.col("positives").alias("p")
    )
    backward = forward.select(
        F.col("partner").alias("id"), F.col("id").alias("partner"), F.col("p").alias("q")
    )
    mutual = (
        forward.join(backward, ["id", "partner"])
        .filter((F.col("p") != F.col("q")) & (F.col("id") < F.col("partner")))
        .select("id", "partner")
    )
    return twins.unionByName(mutual)


def remove_tomek_links(
    df: DataFrame, id_column: str, features: list[str], block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Rows that are in no Tomek link; both ends of a link go."""
    links = tomek_links(df, id_column, features, block_rows)
    gone = links.select(F.explode(F.array("id", "partner")).alias("_gone"))
    return df.join(gone, F.col(id_column).cast("string") == F.col("_gone"), "left_anti")


def rebalance(
    df: DataFrame,
    id_column: str,
    features: list[str],
    k: int = 5,
    seed: int = schema.SEED,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Oversample the smaller class to parity, then drop Tomek links."""
    grown = materialize(oversample(df, id_column, features, k, seed, block_rows), "grown")
    return remove_tomek_links(grown, "id", features, block_rows)
