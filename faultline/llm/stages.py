"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and returns the documents it keeps.

Every stage reads only doc_id and text, and labels where it learns; all other columns pass through.
Rows without doc_id are documents like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm import language
from faultline.llm.common import LEAST_ID, columns_of, prepared, text_of
from faultline.llm.digest_index import DigestIndex, deduplicate, digest_of, matching_rows
from faultline.llm.packing import pack
from faultline.llm.quality import STATS, base_failed, features, first_match, learned, with_statistics
from faultline.llm.simhash import fingerprints, near_groups

# Below this cosine with every language a text is in none of them.
LEAST_SCORE = 0.2


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and meet no learned rule."""
    prepared(spark)
    rules = learned(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    judged = with_statistics(docs, *columns_of(docs))
    return judged.filter(~base_failed() & (first_match(rules, features()) == 0)).drop(STATS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents written in one of the learned languages; all of them where no language was learned."""
    prepared(spark)
    prototypes = language.learn(docs)
    if not prototypes:
        return docs
    rows = docs.select(F.struct(*columns_of(docs)).alias("_fl_row"), "text")
    judged = language.identify(rows, prototypes, "_fl_row")
    known = (F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return judged.filter(known).select("_fl_row.*")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each text, the one with the largest doc_id."""
    prepared(spark)
    with DigestIndex(spark) as index:
        kept = deduplicate(docs, index).filter("kept")
    chosen = kept.select("doc_id", F.col("text_sha256").alias("mark"))
    return matching_rows(docs, chosen, digest_of(F.col("text")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document for each component of near-duplicates, the one with the smallest doc_id."""
    prepared(spark)
    mark = F.xxhash64(text_of())
    rows = near_groups(fingerprints(docs, mark.alias("mark")))
    id_ = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_ID))
    chosen = rows.groupBy("root").agg(F.min(id_).alias("doc_id"), F.min_by("mark", id_).alias("mark"))
    return matching_rows(docs, chosen, mark)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in training sequences."""
    prepared(spark)
    return pack(docs, "word_bpe_49k.json")
