"""From a labelled dataset to ranked, saved models."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline import schema
from faultline.operators import evaluation, training
from faultline.operators.balance import rebalance
from faultline.operators.sampling import bounded, stratified_split
from faultline.operators.selection import select_best_method, select_features
from faultline.operators.spread import running_sum
from faultline.operators.training import Settings, Trained
from faultline.session import materialize
from faultline.sources.datasets import aligned_union, prepare, read_labelled, write_dataset
from faultline.sources.model_store import save_models

# a mined dataset of fewer rows, without a base, gets a warning
FEW_ROWS = 50


@dataclass
class TrainingConfig:
    test_fraction: float = 0.30
    seed: int = schema.SEED
    whitelist: list[str] = field(default_factory=lambda: list(schema.SAFE_FEATURES))
    extra_features: list[str] = field(default_factory=list)
    # 'best' tries several methods, a method name uses that one, None keeps all features
    selection: str | None = "best"
    methods: tuple[str, ...] = ("selectkbest", "rfe", "importance")
    judge_trees: int = 50
    choose_on_test: bool = False
    balance: bool = True
    models: list[str] | None = None
    # parameters that replace those of a preset, by model name
    settings: Settings | None = None
    # about as many rows at most are fitted on, small classes whole, by hash of their content; None fits on all.
    # Statistics that select features and rows that judge them are never bounded
    max_fit_rows: int | None = None
    leakage_check: bool = False
    parallelism: int = training.PARALLELISM
    # where the base dataset with the new rows is written, as CSV if the name ends so, else Parquet
    merged_to: str | None = None
    save_to: str | None = None
    save_top: int | None = None


# The offline run: eleven features, a quarter for testing, a leakage check, no selection.
OFFLINE = TrainingConfig(
    test_fraction=0.25,
    whitelist=list(schema.SCRIPT_FEATURES),
    selection=None,
    leakage_check=True,
    save_top=5,
)


@dataclass
class TrainingResult:
    models: list[Trained]
    features: list[str]
    method: str
    metrics: DataFrame
    leakage: DataFrame | None
    # rows of the base, of the given dataset and of both
    sizes: dict[str, int] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)


def with_row_id(df: DataFrame) -> DataFrame:
    """An id per row from its content and, among equal rows, its number; a written table.

    The ids, and with them every seeded split, do not depend on how the rows are stored. Numbering
    equal rows is cut into buckets like any ordered computation, so many copies are no bottleneck.
    """
    content = F.xxhash64(*(F.col(c).cast("string") for c in sorted(df.columns)))
    rows = materialize(df.withColumns({"_content": content, "_scan": F.monotonically_increasing_id()}), "rows")
    counted = running_sum(rows.select("_content", "_scan"), ["_content"], "_scan", {"_copy": F.lit(1)})
    named = rows.join(counted, ["_content", "_scan"]).withColumn("row_id", F.xxhash64("_content", "_copy"))
    return materialize(named.drop("_content", "_scan", "_copy"), "dataset")


def merge(
    dataset: DataFrame, base: DataFrame | None, merged_to: str | None = None
) -> tuple[DataFrame, dict[str, int], list[str]]:
    """The dataset below its base, the sizes of both and what is to be warned of.

    With ``merged_to`` the merged rows are written there and read back, so that training and later
    readers of the file see the same rows.
    """
    sizes = {"base": 0 if base is None else base.count(), "new": dataset.count()}
    sizes["merged"] = sizes["base"] + sizes["new"]
    merged = dataset if base is None else aligned_union(base, dataset)
    few = base is None and sizes["new"] < FEW_ROWS
    warnings = [f"the dataset is very small ({sizes['new']} rows), results may not be reliable"] if few else []
    if base is not None and not sizes["new"]:
        warnings.append("the dataset has no rows, only its base is used")
    if merged_to:
        format = "csv" if merged_to.rstrip("/").endswith(".csv") else "parquet"
        write_dataset(merged, merged_to, format)
        merged = read_labelled(dataset.sparkSession, merged_to, format=format)
    return merged, sizes, warnings


def run_training(dataset: DataFrame, config: TrainingConfig | None = None, base: DataFrame | None = None) -> TrainingResult:
    """Clean, split, select features, even out classes, fit, measure, rank and save."""
    config = config or TrainingConfig()
    spark = dataset.sparkSession
    merged, sizes, warnings = merge(dataset, base, config.merged_to)
    clean, features = prepare(merged, config.whitelist, extra_features=config.extra_features)
    rows = with_row_id(clean)

    leakage = None
    if config.leakage_check:
        per_fold = training.leakage_check(rows, features, "row_id", settings=config.settings, seed=config.seed)
        leakage = evaluation.fold_summary(per_fold)

    parts = stratified_split(rows, "y", "row_id", config.test_fraction, config.seed)
    train = materialize(parts.filter(~F.col("is_test")).drop("is_test"), "train")
    fewer = bounded(train, config.max_fit_rows)
    test = materialize(parts.filter("is_test").drop("is_test"), "test")

    method, chosen = "all", features
    if config.selection == "best":
        method, chosen = select_best_method(
            train, features, config.methods, "row_id", config.seed, config.judge_trees,
            test if config.choose_on_test else None, config.max_fit_rows,
        )
    elif config.selection:
        method = config.selection
        chosen = select_features(train, features, method, seed=config.seed, fit_on=fewer)

    fit_on = fewer.select("row_id", "y", *chosen)
    if config.balance:
        fit_on = materialize(rebalance(fit_on, "row_id", chosen, seed=config.seed), "balanced")
    models = training.train_and_measure(
        fit_on, test, chosen, config.models, config.settings, config.seed, config.parallelism
    )
    if config.save_to:
        save_models(spark, models, config.save_to, config.save_top)
    return TrainingResult(models, chosen, method, training.metrics_table(spark, models), leakage, sizes, warnings)
