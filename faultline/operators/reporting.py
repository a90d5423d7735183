"""Result tables over stored predictions and model metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from faultline.functions.messages import line_range, pretty_label


def risk_band(p) -> Column:
    p = F.col(p) if isinstance(p, str) else p
    return F.when(p >= 0.50, "red").when(p >= 0.25, "yellow").otherwise("green")


def verdict(f1) -> Column:
    f1 = F.col(f1) if isinstance(f1, str) else f1
    return (
        F.when(f1 > 0.80, "excellent").when(f1 > 0.70, "very good").when(f1 > 0.60, "good").otherwise("moderate")
    )


def first_predictions(predictions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One prediction per key, the first by order; an aggregation, so copies combine map-side.

    Rows are kept whole, which makes Spark sort them by key. A hash in front of the key is compared as a number, while
    names that begin alike are compared to their ends.
    """
    rest = [c for c in predictions.columns if c not in keys]
    return (
        predictions.groupBy(F.xxhash64(*keys).alias("_key"), *keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
        .select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])
    )


def result_rows(predictions: DataFrame) -> DataFrame:
    """The function-level result table with every column filled."""
    return predictions.select(
        F.coalesce("filename", F.lit("unknown")).alias("filename"),
        F.coalesce("function_name", F.lit("Unknown")).alias("function_name"),
        line_range("function_start_line", "function_end_line").alias("function_lines"),
        F.coalesce("name", F.lit("Unknown Model")).alias("model"),
        F.coalesce("probability", F.lit(0.0)).alias("probability"),
        F.coalesce("label", F.lit("CLEAN")).alias("label"),
        risk_band(F.coalesce("probability", F.lit(0.0))).alias("risk_band"),
    )


def filter_results(results: DataFrame, show: str = "all") -> DataFrame:
    return results if show == "all" else results.filter(F.col("label") == show.upper())


def sort_results(results: DataFrame, column: str, ascending: bool = True) -> DataFrame:
    """Numbers by value, everything else as text without regard to case."""
    numeric = isinstance(results.schema[column].dataType, NumericType)
    key = F.col(column) if numeric else F.lower(F.coalesce(F.col(column).cast("string"), F.lit("")))
    return results.orderBy(key.asc() if ascending else key.desc())


def by_function(predictions: DataFrame, function: list[str], meta: list[str], model: str = "name") -> DataFrame:
    """Predictions of each function as an array, one entry per model, with the first row's metadata."""
    once = first_predictions(predictions, [*function, model], ["model_id", *meta])
    entry = F.struct(F.col(model).alias("name"), "probability", "label")
    grouped = once.groupBy(F.xxhash64(*function).alias("_key"), *function).agg(
        *[F.min_by(c, F.struct("model_id", *meta)).alias(c) for c in meta],
        F.array_sort(F.collect_list(entry)).alias("predictions"),  # at most one entry per model
    )
    return grouped.drop("_key")


def prediction_counts(predictions: DataFrame, function: list[str]) -> DataFrame:
    """Predictions (functions x models) and distinct functions."""
    per_function = predictions.groupBy(*function).agg(F.count(F.lit(1)).alias("n"))
    return per_function.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("prediction_count"), F.count(F.lit(1)).alias("function_count")
    )


def top_importances(importances: DataFrame, n: int = 10) -> DataFrame:
    """The n largest importances with their share of the largest."""
    largest = F.max("importance").over(Window.partitionBy())  # over at most n rows
    return (
        importances.orderBy(F.desc("importance"), "feature")
        .limit(n)
        .withColumn("label", pretty_label("feature"))
        .withColumn("width", F.col("importance") / largest * 100.0)
    )


def summary(metrics: DataFrame) -> DataFrame:
    """Best model and the list of all models, best first; one row per model goes in."""
    best = F.max_by(F.struct("model_name", "f1", "accuracy", "recall", "precision", "roc_auc"), F.struct("f1", -F.col("position")))
    listed = F.array_sort(
        F.collect_list(F.struct((-F.col("f1")).alias("o"), "position", "model_name", "f1", "accuracy", "recall", "precision"))
    )
    return metrics.agg(best.alias("b"), F.count(F.lit(1)).alias("total_models"), listed.alias("l")).select(
        F.col("b.model_name").alias("best_model"),
        *[F.col(f"b.{c}").alias(f"best_{c}") for c in ("f1", "accuracy", "recall", "precision", "roc_auc")],
        "total_models",
        F.transform(
            "l", lambda m: F.struct(m["model_name"].alias("name"), m["f1"], m["accuracy"], m["recall"], m["precision"])
        ).alias("all_models"),
    )


def model_options(models: DataFrame, key: str = "model_id", label: str = "model_name") -> DataFrame:
    """Selectable models, one per label, sorted by label."""
    return (
        models.groupBy(F.col(label).alias("label")).agg(F.min(key).alias("id")).select("id", "label").orderBy("label")
    )
