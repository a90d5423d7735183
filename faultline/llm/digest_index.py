"""Exact deduplication against a persistent index of digests."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.common import LEAST_ID, columns_of, join_groups, text_of
from faultline.session import materialize, path_exists, scratch


def digest_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


class DigestIndex:
    """A table of known digests, bucketed and sorted by digest in a shared folder.

    New digests are shuffled into the same buckets, so looking them up is a sort-merge anti-join
    that moves nothing of the index, and appending them writes one file a bucket. The number of
    buckets is fixed when the folder is first used and is kept beside the files; opening the folder
    again, in any session, registers the files that lie there and writes nothing. The catalog's
    entry is named after the folder and can go at any time (``close``). One job appends at a time.
    """

    SCHEMA = "digest string, doc_id long, batch string"
    LAYOUT = "version int, buckets int"
    VERSION = 1

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark = spark
        self.path = (path or scratch(spark, "digest-index")).rstrip("/")
        self.files = f"{self.path}/digests"
        self.table = f"digests_{hashlib.sha256(self.path.encode()).hexdigest()[:24]}"
        self.buckets = self._layout(buckets)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} ({self.SCHEMA}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.files}'"
        )
        spark.catalog.refreshTable(self.table)

    def _layout(self, buckets: int | None) -> int:
        """The number of buckets the folder has; a folder that is not there gets one."""
        reader = self.spark.read.schema(self.LAYOUT)
        if not path_exists(self.spark, self.path):
            buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            row = self.spark.createDataFrame([(self.VERSION, buckets)], self.LAYOUT)
            row.coalesce(1).write.json(f"{self.path}/layout")
            return buckets
        found = reader.json(f"{self.path}/layout").take(2) if path_exists(self.spark, f"{self.path}/layout/_SUCCESS") else []
        if len(found) != 1 or found[0]["version"] != self.VERSION or not found[0]["buckets"]:
            raise ValueError(f"{self.path} is no digest index of layout {self.VERSION}")
        if buckets and buckets != found[0]["buckets"]:
            raise ValueError(f"{self.path} has {found[0]['buckets']} buckets, not {buckets}")
        return found[0]["buckets"]

    def close(self) -> None:
        """Take the index out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def __enter__(self) -> DigestIndex:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def known(self) -> DataFrame:
        """digest of every text that was kept so far, with its doc_id and the batch that brought it."""
        return self.spark.table(self.table)

    def unknown(self, groups: DataFrame) -> DataFrame:
        """The rows of ``groups`` (digest, ...) whose digest the index does not have."""
        return groups.hint("merge").join(self.known().select("digest"), "digest", "left_anti")

    def add(self, groups: DataFrame, batch: str) -> None:
        """Append the digests that are new, with the doc_id in ``keep_id``."""
        new = self.unknown(groups).select("digest", F.col("keep_id").cast("long").alias("doc_id"), F.lit(batch).alias("batch"))
        new = materialize(new, "digests-new")  # the index is not read while it is written
        new.repartition(self.buckets, "digest").write.insertInto(self.table)


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """One row per row of ``docs``: which document stays for its text; new texts enter the index.

    Texts are equal when identical; null counts as empty. A text that another batch brought into the
    index is represented by the indexed document and none of its rows is kept. Otherwise the row
    with the largest doc_id stays (null is smaller than any; of rows that repeat this doc_id,
    exactly one). An empty table gives no rows and changes nothing. Other columns are not read.

    ``batch`` names the batch. A job that failed after texts had entered the index runs again under
    the same name and gives the same rows; without a name every call is a batch of its own.

    Texts never move: each becomes a digest where it is read. Counting combines before the shuffle,
    and the way back to the rows treats hot digests apart.
    """
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    digests = docs.select("doc_id", digest_of(F.col("text")).alias("digest"), F.monotonically_increasing_id().alias("_row"))
    digests = materialize(digests, "digests")
    groups = digests.groupBy("digest").agg(
        F.max("doc_id").alias("keep_id"),
        F.max_by("_row", id_).alias("_keep_row"),
        F.count(F.lit(1)).alias("group_size"),
    )
    groups = materialize(groups, "digest-groups")
    batch = batch or uuid.uuid4().hex
    index.add(groups, batch)
    known = index.known().withColumnsRenamed({"doc_id": "keep_id", "batch": "_batch"})
    groups = groups.drop("keep_id").hint("merge").join(known, "digest")
    groups = materialize(groups.withColumn("_new", F.col("_batch") == batch).drop("_batch"), "digest-groups")
    return join_groups(digests, groups, "digest", "group_size").select(
        "doc_id",
        "keep_id",
        "group_size",
        (F.col("_new") & (F.col("_row") == F.col("_keep_row"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def matching_rows(docs: DataFrame, chosen: DataFrame, mark: Column) -> DataFrame:
    """The whole rows of ``docs`` whose doc_id and ``mark`` are in ``chosen`` (doc_id, mark), each once.

    Both sides are cut alike by id and mark, so rows that repeat an id and its text are found
    without another shuffle. Row numbers of a scan are never compared with those of another scan.
    """
    marked = docs.withColumn("_fl_mark", mark).withColumn("_fl_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)))
    wanted = chosen.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID)).alias("_fl_id"), F.col("mark").alias("_fl_mark"))
    kept = marked.join(wanted.distinct(), ["_fl_id", "_fl_mark"], "left_semi")
    return kept.dropDuplicates(["_fl_id", "_fl_mark"]).select(*columns_of(docs))
