"""What the training-data operators share: null-safe texts, joins that no key can skew, dense numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.session import materialize, tune

# Python workers get whole texts; batches stay small enough for a few long ones.
ARROW_SETTINGS = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20),
}
# A group with more than this share of the rows is hot; there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
LEAST_ID = -(2**63)
SEPARATORS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def prepared(spark: SparkSession) -> SparkSession:
    for key, value in ARROW_SETTINGS.items():
        spark.conf.set(key, value)
    return tune(spark)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/documents.parquet")


def columns_of(df: DataFrame) -> list[Column]:
    """All columns, whatever signs their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def text_of(column: str = "text") -> Column:
    """The text, or the empty text for null."""
    return F.coalesce(F.col(column), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas inside use it for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str) -> DataFrame:
    """Each row with the columns of its group; ``groups`` has one row a key, ``size`` its number of rows.

    A key may hold any share of the rows. Groups with more than 1/HOT_SHARE of all rows are fewer
    than HOT_SHARE, so that part is broadcast; the others have few rows each and meet in a shuffle
    join. Both inputs are read twice and should be written tables. Rows without a group go.
    """
    total = groups.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * HOT_SHARE > total
    hot = F.broadcast(groups.filter(is_hot))
    found = rows.join(hot, key)
    others = rows.join(hot.select(key), key, "left_anti").join(groups.filter(~is_hot), key)
    return found.unionByName(others)


def numbered(df: DataFrame, order: list[str], name: str, number: str = "row_no") -> DataFrame:
    """Rows with dense numbers from 0 in the given order, which must tell any two rows apart.

    The order is dealt out by ranges; each range counts its own rows and starts where the ranges
    before it end, so no task sees more than its share. The only unpartitioned window has one row
    a range. ``df`` is read twice and should be a written table.
    """
    at = "_at"
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = materialize(placed.withColumn(at, F.monotonically_increasing_id()), name)
    ranges = placed.groupBy(F.shiftright(at, 33).alias("_range")).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    place = F.col("_start") + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    joined = placed.join(F.broadcast(starts), F.shiftright(at, 33) == F.col("_range"))
    return joined.withColumn(number, place).drop(at, "_range", "_start")
