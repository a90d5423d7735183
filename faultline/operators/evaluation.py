"""Measures of scored rows per model. Input: model, y (0/1) and a probability."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import schema
from faultline.operators.spread import ROWS_PER_BUCKET, running_sum
from faultline.session import materialize


def class_ratio(df: DataFrame, y: str = "y") -> DataFrame:
    """Negatives per positive, the weight of the positive class."""
    negatives, positives = F.count_if(F.col(y) == 0), F.count_if(F.col(y) == 1)
    return df.agg(
        negatives.alias("negatives"),
        positives.alias("positives"),
        F.try_divide(negatives.cast("double"), positives).alias("ratio"),
    )


def _zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0.0))


def confusion(
    df: DataFrame, model: str = "model", y: str = "y", p: str = "probability",
    threshold: float = schema.DECISION_THRESHOLD,
) -> DataFrame:
    said = F.col(p) >= threshold
    true = F.col(y) == 1
    return df.groupBy(model).agg(
        F.count_if(true & said).alias("tp"),
        F.count_if(~true & ~said).alias("tn"),
        F.count_if(~true & said).alias("fp"),
        F.count_if(true & ~said).alias("fn"),
    )


def with_scores(counts: DataFrame) -> DataFrame:
    """Accuracy, precision, recall, F1 and Matthews correlation; 0 where undefined."""
    tp, tn, fp, fn = (F.col(c).cast("double") for c in ("tp", "tn", "fp", "fn"))
    spread = F.sqrt(tp + fp) * F.sqrt(tp + fn) * F.sqrt(tn + fp) * F.sqrt(tn + fn)
    return counts.withColumns(
        {
            "accuracy": _zero(F.try_divide(tp + tn, tp + tn + fp + fn)),
            "precision": _zero(F.try_divide(tp, tp + fp)),
            "recall": _zero(F.try_divide(tp, tp + fn)),
            "f1": _zero(F.try_divide(2 * tp, 2 * tp + fp + fn)),
            "mcc": _zero(F.try_divide(tp * tn - fp * fn, spread)),
        }
    )


def _by_score(df: DataFrame, model: str, y: str, p: str) -> DataFrame:
    """Positives and negatives per distinct score: all that ranking needs. Written once, read often."""
    counts = df.groupBy(F.col(model).alias("model"), F.col(p).alias("p")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")
    )
    return materialize(counts, "scores")


def roc_auc(
    df: DataFrame, model: str = "model", y: str = "y", p: str = "probability",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Exact area under the ROC curve, ties counting one half; 0 if a class is missing."""
    ranked = running_sum(
        _by_score(df, model, y, p), ["model"], "p", {"neg_upto": F.col("neg")}, rows_per_bucket=rows_per_bucket
    )
    below = F.col("neg_upto") - F.col("neg") / 2.0
    return ranked.groupBy("model").agg(
        _zero(
            F.try_divide(
                F.sum(F.col("pos") * below), F.sum("pos").cast("double") * F.sum("neg").cast("double")
            )
        ).alias("roc_auc")
    ).withColumnRenamed("model", model)


def roc_points(
    df: DataFrame, model: str = "model", y: str = "y", p: str = "probability",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """False and true positive rate at each distinct score taken as threshold."""
    scores = _by_score(df, model, y, p).withColumn("_down", -F.col("p"))
    ranked = running_sum(
        scores, ["model"], "_down", {"tp": F.col("pos"), "fp": F.col("neg")}, rows_per_bucket=rows_per_bucket
    )
    totals = scores.groupBy("model").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    # one row per model
    return ranked.join(F.broadcast(totals), "model").select(
        F.col("model").alias(model),
        F.col("p").alias("threshold"),
        _zero(F.try_divide(F.col("fp").cast("double"), F.col("_neg"))).alias("fpr"),
        _zero(F.try_divide(F.col("tp").cast("double"), F.col("_pos"))).alias("tpr"),
    )


def model_metrics(
    df: DataFrame, model: str = "model", y: str = "y", p: str = "probability",
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """One row per model with every measure."""
    return with_scores(confusion(df, model, y, p)).join(
        roc_auc(df, model, y, p, rows_per_bucket), model
    )


def confusion_share(counts: DataFrame, model: str = "model") -> DataFrame:
    """Each cell of the confusion matrix with its share of all rows in percent."""
    total = F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")
    cells = [
        F.struct(F.lit(c).alias("cell"), F.col(c).alias("n"), (F.col(c) * 100.0 / total).alias("percent"))
        for c in ("tn", "fp", "fn", "tp")
    ]
    return counts.select(model, F.explode(F.array(*cells)).alias("c")).select(model, "c.*")


def fold_summary(per_fold: DataFrame) -> DataFrame:
    """Mean and population deviation over folds, with the leakage verdict on accuracy."""
    mean = F.avg("accuracy")
    return per_fold.agg(
        *[F.avg(c).alias(f"{c}_mean") for c in ("accuracy", "f1", "roc_auc")],
        *[F.stddev_pop(c).alias(f"{c}_std") for c in ("accuracy", "f1", "roc_auc")],
        F.when(mean > 0.90, "leakage")
        .when(mean > 0.85, "possible leakage")
        .otherwise("realistic")
        .alias("verdict"),
    )


def ranked_models(metrics: DataFrame, order: str = "position") -> DataFrame:
    """Models by F1, best first; equal scores keep the training order. There are a handful."""
    return metrics.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.desc("f1"), order))
    )
