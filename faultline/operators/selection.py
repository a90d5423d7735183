"""Choosing features: univariate scores from one aggregation each, and forest-based methods."""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline import schema
from faultline.operators.sampling import bounded, stratified_split
from faultline.operators.spread import ROWS_PER_BUCKET, nearby_rows, running_sum
from faultline.session import materialize

log = logging.getLogger(__name__)


def feature_count(width: int, wanted: int | None = None) -> int:
    """Half of the features, at least 5 and at most 10, never more than there are."""
    return min(width, min(10, max(5, width // 2)) if wanted is None else wanted)


def _long(row: DataFrame, features: list[str], value) -> DataFrame:
    """One row per feature from a one-row frame; ``value(i)`` builds the score of feature i."""
    entries = [
        F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature"), value(i).alias("score"))
        for i, f in enumerate(features)
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def anova_scores(df: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """F statistic of each feature between the classes; 0 where undefined."""
    per_class = df.groupBy(y).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.var_pop(f).alias(f"v{i}") for i, f in enumerate(features)],
    )
    n, classes = F.sum("n"), F.count(F.lit(1))
    row = per_class.agg(
        n.alias("n"),
        classes.alias("k"),
        *[F.sum(F.col("n") * F.col(f"v{i}")).alias(f"w{i}") for i in range(len(features))],
        # between-class sum of squares as the weighted spread of class means
        *[
            (F.sum(F.col("n") * F.col(f"m{i}") * F.col(f"m{i}")) - F.pow(F.sum(F.col("n") * F.col(f"m{i}")), F.lit(2)) / F.sum("n")).alias(f"b{i}")
            for i in range(len(features))
        ],
    )

    def score(i: int) -> Column:
        between = F.try_divide(F.greatest(F.col(f"b{i}"), F.lit(0.0)), (F.col("k") - 1).cast("double"))
        within = F.try_divide(F.col(f"w{i}"), F.col("n") - F.col("k"))
        return F.coalesce(F.try_divide(between, within), F.lit(0.0))

    return _long(row, features, score)


def chi2_scores(df: DataFrame, features: list[str], y: str = "y") -> DataFrame:
    """Chi-squared of values taken as counts after shifting each feature's minimum to 1."""
    per_class = df.groupBy(y).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        *[F.sum(F.col(f).cast("double")).alias(f"s{i}") for i, f in enumerate(features)],
        *[F.min(F.col(f).cast("double")).alias(f"l{i}") for i, f in enumerate(features)],
    )
    # one row per class from here on
    every = Window.partitionBy()
    observed = per_class.select(
        "n",
        F.sum("n").over(every).alias("total"),
        *[
            (F.col(f"s{i}") + F.col("n") * (1.0 - F.min(f"l{i}").over(every))).alias(f"o{i}")
            for i in range(len(features))
        ],
    )
    expected = observed.select(
        *[f"o{i}" for i in range(len(features))],
        *[
            (F.col("n") / F.col("total") * F.sum(f"o{i}").over(every)).alias(f"e{i}")
            for i in range(len(features))
        ],
    )
    row = expected.agg(
        *[
            F.sum(F.pow(F.col(f"o{i}") - F.col(f"e{i}"), F.lit(2)) / F.col(f"e{i}")).alias(f"c{i}")
            for i in range(len(features))
        ]
    )
    return _long(row, features, lambda i: F.coalesce(F.col(f"c{i}"), F.lit(0.0)))


def mutual_information(
    df: DataFrame, features: list[str], y: str = "y", bins: int = 32, binning: str = "width"
) -> DataFrame:
    """Mutual information in nats between each binned feature and the class.

    A binned estimate: ``width`` cuts each feature's range evenly, ``quantile`` at its quantiles.
    """
    if binning == "quantile":
        probabilities = [i / bins for i in range(1, bins)]
        cuts = df.approxQuantile(features, probabilities, 0.001)

        def bin_of(i: int, f: str) -> Column:
            points = F.array(*[F.lit(float(c)) for c in sorted(set(cuts[i]))])
            return F.size(F.filter(points, lambda c: c < F.col(f)))

        ranged = df
    else:
        low_high = df.agg(
            *[F.min(f).cast("double").alias(f"_l{i}") for i, f in enumerate(features)],
            *[F.max(f).cast("double").alias(f"_h{i}") for i, f in enumerate(features)],
        )

        def bin_of(i: int, f: str) -> Column:
            share = F.try_divide(F.col(f) - F.col(f"_l{i}"), F.col(f"_h{i}") - F.col(f"_l{i}"))
            return F.least(F.lit(bins - 1), F.floor(F.coalesce(share, F.lit(0.0)) * bins)).cast("int")

        ranged = df.crossJoin(F.broadcast(low_high))  # one row

    entries = [F.struct(F.lit(i).alias("position"), bin_of(i, f).alias("bin")) for i, f in enumerate(features)]
    cells = (
        ranged.select(F.col(y).alias("y"), F.explode(F.array(*entries)).alias("e"))
        .groupBy("e.position", "e.bin", "y")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
    )
    # at most features x bins x 2 rows
    joint = cells.select(
        "position",
        "n",
        F.sum("n").over(Window.partitionBy("position")).alias("total"),
        F.sum("n").over(Window.partitionBy("position", "bin")).alias("in_bin"),
        F.sum("n").over(Window.partitionBy("position", "y")).alias("in_class"),
    )
    names = F.array(*[F.lit(f) for f in features])
    return (
        joint.groupBy("position")
        .agg(
            F.sum(
                F.col("n") / F.col("total") * F.log(F.col("n") * F.col("total") / (F.col("in_bin") * F.col("in_class")))
            ).alias("score")
        )
        .select("position", F.element_at(names, F.col("position") + 1).alias("feature"), "score")
    )


def digamma(n: Column) -> Column:
    """Digamma of a positive number: ten steps up, then the asymptotic series (errors below 1e-10)."""
    x = n.cast("double") + 10.0
    square = 1.0 / (x * x)
    series = F.log(x) - 0.5 / x - square * (1 / 12 - square * (1 / 120 - square / 252))
    return series - sum((1.0 / (n.cast("double") + float(i)) for i in range(10)), F.lit(0.0))


def neighbour_information(
    df: DataFrame, features: list[str], y: str = "y", neighbours: int = 3, rows_per_bucket: int = ROWS_PER_BUCKET
) -> DataFrame:
    """Mutual information in nats between each numeric feature and the class, by nearest neighbours; at least 0.

    A row's radius is the distance to its ``neighbours``-th nearest row of the same class (fewer in smaller
    classes; classes of one row do not count). The estimate compares how many rows of any class lie nearer,
    itself included. With a radius of 0 these are the rows with the same value; no noise parts ties, so the
    result is the same on every run. Rows with a null in a feature or the class do not count there.

    Rows are counted by (feature, class, value) before anything is ordered. Features and classes of any size
    are cut along the value: radii need a few neighbours on both sides, counts inside a radius are
    differences of running sums at its two ends.
    """
    entries = [F.struct(F.lit(i).alias("position"), F.col(f).cast("double").alias("x")) for i, f in enumerate(features)]
    values = (
        df.select(F.col(y).alias("y"), F.explode(F.array(*entries)).alias("e"))
        .select("y", "e.position", "e.x")
        .filter("y IS NOT NULL AND x IS NOT NULL")
        .groupBy("position", "y", "x")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    values = materialize(values, "feature-values")
    classes = values.groupBy("position", "y").agg(F.sum("n").alias("class_rows")).filter("class_rows > 1")
    values = values.join(F.broadcast(classes), ["position", "y"])  # a row per feature and class

    near = nearby_rows(values, ["position", "y"], "x", ["x", "n"], neighbours, rows_per_bucket)
    k = F.least(F.lit(neighbours).cast("long"), F.col("class_rows") - 1)
    sides = [F.try_element_at("before", F.lit(-i)) for i in range(1, neighbours + 1)] + [F.get("after", F.lit(i)) for i in range(neighbours)]
    near = near.select(
        "position", "y", "x", "n", "class_rows", k.alias("k"),
        *[F.abs(e["x"] - F.col("x")).alias(f"_d{i}") for i, e in enumerate(sides)],
        *[e["n"].alias(f"_n{i}") for i, e in enumerate(sides)],
    )
    # the smallest distance within which there are k others
    reaches = []
    for i in range(len(sides)):
        met = [F.when(F.col(f"_d{j}") <= F.col(f"_d{i}"), F.col(f"_n{j}")).otherwise(0) for j in range(len(sides))]
        reaches.append(F.when(sum(met, F.col("n") - 1) >= F.col("k"), F.col(f"_d{i}")))
    radius = F.when(F.col("n") > F.col("k"), F.lit(0.0)).otherwise(F.least(*reaches))
    radii = near.select("position", "y", "x", "n", "class_rows", "k", radius.alias("r"))
    radii = radii.withColumns({"low": F.col("x") - F.col("r"), "high": F.col("x") + F.col("r")})
    radii = materialize(radii, "radii")

    none = F.lit(0).cast("long").alias("n")
    ends = (
        radii.select("position", F.col("x").alias("at"), "n")
        .unionByName(radii.select("position", F.col("low").alias("at"), none))
        .unionByName(radii.select("position", F.col("high").alias("at"), none))
    )
    ends = materialize(ends.groupBy("position", "at").agg(F.sum("n").alias("here")), "radius-ends")
    sums = running_sum(ends, ["position"], "at", {"upto": F.col("here")}, rows_per_bucket=rows_per_bucket)
    sums = materialize(sums, "running-counts")
    below = sums.select("position", F.col("at").alias("low"), F.col("upto").alias("_low"))
    above = sums.select("position", F.col("at").alias("high"), (F.col("upto") - F.col("here")).alias("_high"), "here")
    counted = radii.join(below, ["position", "low"]).join(above, ["position", "high"])
    inside = F.when(F.col("r") > 0, F.col("_high") - F.col("_low")).otherwise(F.col("here"))
    each = digamma(F.col("k")) - digamma(F.col("class_rows")) - digamma(inside)
    scores = counted.groupBy("position").agg(
        F.sum("n").alias("rows"), (F.sum(F.col("n") * each) / F.sum("n")).alias("rest")
    )
    scored = scores.select("position", F.greatest(F.lit(0.0), digamma(F.col("rows")) + F.col("rest")).alias("score"))
    named = [F.struct(F.lit(i).alias("position"), F.lit(f).alias("feature")) for i, f in enumerate(features)]
    listed = df.sparkSession.range(1).select(F.explode(F.array(*named)).alias("e")).select("e.*")
    return listed.join(scored, "position", "left").na.fill(0.0, ["score"])


def top_features(scores: DataFrame, n: int) -> list[str]:
    """The n best features, back in the order of the data."""
    best = scores.orderBy(F.desc("score"), "position").limit(n).collect()
    return [r["feature"] for r in sorted(best, key=lambda r: r["position"])]


DEEPEST = 30  # Spark's limit on the depth of a tree
FIT_TASKS = 12  # every level of a forest sends the statistics of all its nodes from each task


def _forest(df: DataFrame, features: list[str], trees: int, seed: int, depth: int):
    assembled = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    # rows remember their nodes, so that no level sends all trees to every task; the trees are the same
    return RandomForestClassifier(
        labelCol="y", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True
    ).fit(assembled)


def forest_importances(
    df: DataFrame, features: list[str], trees: int = 100, seed: int = schema.SEED, depth: int = DEEPEST
) -> list[tuple[str, float]]:
    """Features with their importance, best first; equal ones keep their order."""
    values = _forest(df, features, trees, seed, depth).featureImportances.toArray()
    return sorted(zip(features, map(float, values)), key=lambda fv: -fv[1])


def eliminate(
    df: DataFrame, features: list[str], n: int, trees: int = 50, seed: int = schema.SEED, depth: int = DEEPEST
) -> list[str]:
    """Drop the least important feature of a fresh forest until n are left."""
    left = list(features)
    while len(left) > n:
        weakest = forest_importances(df, left, trees, seed, depth)[-1][0]
        left.remove(weakest)
    return left


def select_features(
    df: DataFrame,
    features: list[str],
    method: str = "selectkbest",
    n: int | None = None,
    seed: int = schema.SEED,
    trees: int | None = None,
    fit_on: DataFrame | None = None,
) -> list[str]:
    """Features chosen by a method; an unknown or failing method keeps all of them.

    Statistics come from all rows; forests are fitted on ``fit_on`` if that is given.
    """
    n = feature_count(len(features), n)
    fit_on = df if fit_on is None else fit_on
    try:
        if method == "selectkbest":
            return top_features(anova_scores(df, features), n)
        if method == "mutual_info":
            return top_features(neighbour_information(df, features), n)
        if method == "chi2":
            return top_features(chi2_scores(df, features), n)
        if method == "rfe":
            return eliminate(fit_on, features, n, trees or 50, seed)
        if method == "importance":
            return [f for f, _ in forest_importances(fit_on, features, trees or 100, seed)][:n]
        log.warning("unknown feature selection method %s, keeping all features", method)
    except Exception as e:  # a failing selector must not stop a training run
        log.warning("feature selection %s failed (%s), keeping all features", method, e)
    return list(features)


def select_best_method(
    train: DataFrame,
    features: list[str],
    methods: tuple[str, ...] = ("selectkbest", "rfe", "importance"),
    id_column: str = "row_id",
    seed: int = schema.SEED,
    judge_trees: int = 50,
    test: DataFrame | None = None,
    max_fit_rows: int | None = None,
) -> tuple[str, list[str]]:
    """The method whose features give a forest of ``judge_trees`` the best accuracy; the first one wins ties.

    Accuracy is taken on a held-out fifth of the training rows. Passing ``test`` uses those rows
    instead, which leaks the test set into the choice. ``max_fit_rows`` bounds the rows that forests are
    fitted on, not those that give statistics or judge. Methods are tried side by side.
    """
    if test is None:
        parts = stratified_split(train, "y", id_column, 0.2, seed + 1)
        fit_on, judge_on = parts.filter(~F.col("is_test")).cache(), parts.filter("is_test").cache()
    else:
        fit_on, judge_on = train, test
    fewer = kept = bounded(fit_on, max_fit_rows, id_column=id_column)
    if max_fit_rows:
        kept = fewer.cache()
        kept.count()  # by all tasks, then fitted by few
        fewer = kept.coalesce(FIT_TASKS)

    def judge(method: str) -> tuple[list[str], float | None]:
        chosen = select_features(fit_on, features, method, seed=seed, fit_on=fewer)
        model = _forest(fewer, chosen, judge_trees, seed, DEEPEST)
        judged = model.transform(VectorAssembler(inputCols=chosen, outputCol="features").transform(judge_on))
        return chosen, judged.agg(F.avg((F.col("prediction") == F.col("y")).cast("double"))).first()[0]

    best = ("none", list(features), -1.0)
    with ThreadPoolExecutor(max(1, len(methods))) as pool:
        for method, (chosen, accuracy) in zip(methods, pool.map(judge, methods)):
            if accuracy is not None and accuracy > best[2]:
                best = (method, chosen, accuracy)
    if max_fit_rows:
        kept.unpersist()
    if test is None:
        fit_on.unpersist()
        judge_on.unpersist()
    return best[0], best[1]
