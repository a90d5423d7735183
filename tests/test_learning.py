import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import balance, evaluation, neighbours, reporting, sampling, scaling, scoring, selection, training
from faultline.plans import catalog
from faultline.plans.training import OFFLINE, TrainingConfig, merge, run_training
from faultline.session import scratch
from faultline.sources import datasets, model_store
from faultline.sources.datasets import aligned_union, read_labelled
from faultline.streaming import jobs

SMALL = {
    "Logistic Regression": {"maxIter": 10},
    "Decision Tree": {"maxDepth": 3},
    "Random Forest": {"numTrees": 3, "maxDepth": 3},
    "Gradient Boosting": {"maxIter": 3, "maxDepth": 3},
}


def test_split_is_a_stratified_partition(spark):
    df = spark.range(40).select(F.col("id"), (F.col("id") < 10).cast("int").alias("y"))
    got = sampling.stratified_split(df, "y", "id", 0.30)
    counts = {(r.y, r.is_test): r["count"] for r in got.groupBy("y", "is_test").count().collect()}
    assert counts == {(0, False): 21, (0, True): 9, (1, False): 7, (1, True): 3}
    again = sampling.stratified_split(df.repartition(7), "y", "id", 0.30)
    assert got.exceptAll(again).count() == 0


def test_split_fractions_at_the_ends(spark):
    df = spark.range(11).select(F.col("id"), F.lit(1).alias("y"))
    assert sampling.stratified_split(df, "y", "id", 0.0).filter("is_test").count() == 0
    assert sampling.stratified_split(df, "y", "id", 1.0).filter("is_test").count() == 11


def test_folds_differ_by_one_row(spark):
    df = spark.range(53).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    sizes = sampling.stratified_folds(df, "y", "id").groupBy("y", "fold").count().collect()
    for y in (0, 1):
        per_fold = [r["count"] for r in sizes if r.y == y]
        assert len(per_fold) == 5 and max(per_fold) - min(per_fold) <= 1


def predictions(spark, rows):
    return spark.createDataFrame(rows, "model string, y int, probability double")


def test_golden_metrics(spark):
    rows = [("m", 1, 0.9), ("m", 1, 0.4), ("m", 0, 0.6), ("m", 0, 0.1)]
    rows += [("none", 1, 0.1), ("none", 0, 0.1)]
    got = {r.model: r for r in evaluation.model_metrics(predictions(spark, rows)).collect()}
    m, none = got["m"], got["none"]
    assert (m.tp, m.fn, m.fp, m.tn) == (1, 1, 1, 1)
    assert (m.accuracy, m.precision, m.recall, m.f1, m.mcc, m.roc_auc) == (0.5, 0.5, 0.5, 0.5, 0, 0.75)
    assert (none.precision, none.recall, none.f1, none.mcc, none.roc_auc) == (0, 0, 0, 0, 0.5)


@pytest.mark.parametrize("rows_per_bucket", [10**9, 15])
def test_auc_counts_ties_one_half(spark, rows_per_bucket):
    rng = random.Random(5)
    rows = [("m", rng.randint(0, 1), rng.randint(0, 9) / 10) for _ in range(200)]
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    wanted = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / len(pos) / len(neg)
    df = predictions(spark, rows)
    assert evaluation.roc_auc(df, rows_per_bucket=rows_per_bucket).first().roc_auc == pytest.approx(wanted)
    moved = df.withColumn("probability", F.exp("probability"))
    assert evaluation.roc_auc(moved, rows_per_bucket=rows_per_bucket).first().roc_auc == pytest.approx(wanted)
    curve = evaluation.roc_points(df, rows_per_bucket=rows_per_bucket).orderBy(F.desc("threshold")).collect()
    assert len(curve) == 10 and (curve[-1].fpr, curve[-1].tpr) == (1.0, 1.0)


def test_auc_without_one_class_is_zero(spark):
    assert evaluation.roc_auc(predictions(spark, [("m", 1, 0.3)])).first().roc_auc == 0.0


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    got = scaling.standardize(df, scaling.fitted(df, ["a", "b"])).orderBy("a").collect()
    assert [tuple(r) for r in got] == [(-1.0, 0.0), (1.0, 0.0)]


def test_feature_counts():
    assert [selection.feature_count(p) for p in (14, 11, 3, 30)] == [7, 5, 3, 10]


def test_univariate_scores(spark):
    rng = np.random.default_rng(6)
    y = rng.integers(0, 2, 300)
    x = np.c_[y * 2 + rng.normal(size=300), rng.normal(size=300), np.ones(300)]
    df = spark.createDataFrame([(int(b), *map(float, a)) for a, b in zip(x, y)], "y int, a double, b double, c double")
    scores = {r.feature: r.score for r in selection.anova_scores(df, ["a", "b", "c"]).collect()}
    groups = [x[y == k] for k in (0, 1)]
    between = sum(len(g) * (g.mean(0) - x.mean(0)) ** 2 for g in groups)
    within = sum(((g - g.mean(0)) ** 2).sum(0) for g in groups)
    f = between[:2] / (within[:2] / 298)
    assert [scores["a"], scores["b"]] == pytest.approx(list(f)) and scores["c"] == 0.0
    assert selection.select_features(df, ["a", "b", "c"], "selectkbest", 1) == ["a"]
    for method in ("mutual_info", "chi2", "importance", "rfe"):
        assert "a" in selection.select_features(df, ["b", "a", "c"], method, 2, trees=5)
    assert selection.select_features(df, ["a", "b"], "unknown") == ["a", "b"]


def vectors(spark, n=300, seed=7):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)) * 3)
    x[: n // 3] = [1.0, 2.0, 3.0]  # a third of all rows are copies of one vector
    y = (rng.random(n) < 0.25).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(n)]
    return x, y, spark.createDataFrame(rows, "id long, y int, a double, b double, c double")


@pytest.mark.parametrize("block_rows", [4000, 25])
def test_neighbours_match_brute_force(spark, block_rows):
    _, _, df = vectors(spark)
    distinct = neighbours.distinct_vectors(df, "id", list("abc"))
    rows = distinct.collect()
    x, ids = np.array([r.x for r in rows]), [r.vec for r in rows]
    found = {}
    for r in neighbours.nearest(distinct, 4, block_rows=block_rows).orderBy("rank").collect():
        found.setdefault(r.vec, []).append(r.neighbour)
    for i, name in enumerate(ids):
        d = ((x - x[i]) ** 2).sum(1)
        wanted = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (d[j], ids[j]))[:4]
        assert found[name] == [ids[j] for j in wanted]


@pytest.mark.parametrize("directions", [0, 2])
def test_neighbours_by_certificate_and_by_tree(spark, directions):
    # a grid with very many ties, clusters far from each other, one vector at the far end
    rng = np.random.default_rng(3)
    grid = np.array([(i % 8, i // 8) for i in range(64)], float)
    x = np.unique(np.concatenate([grid, rng.normal(size=(80, 2)).round(3) + 1000, [[1e6, 1e6]]]), axis=0)
    ids = [f"v{i}" for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec string, x array<double>")
    rows = neighbours.nearest(df, 3, block_rows=24, top_pivots=2, directions=directions).collect()
    found = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        found.setdefault(r.vec, []).append(r.neighbour)
    for i, name in enumerate(ids):
        d = ((x - x[i]) ** 2).sum(1)
        wanted = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (d[j], ids[j]))[:3]
        assert found[name] == [ids[j] for j in wanted]
    certified = {r.vec for r in rows if r.certified}
    assert not certified if directions == 0 else 0 < len(certified) < len(ids)


@pytest.mark.parametrize("known", [False, True])
def test_neighbours_within_a_block(known):
    rng = np.random.default_rng(5)
    grid = rng.integers(0, 6, size=(500, 3)).astype(float)  # many ties
    b = np.concatenate([grid, rng.normal(size=(400, 3)) + 50])
    others, ids = np.array([f"v{i}" for i in range(900)], object), np.array([f"v{i}" for i in range(300, 700)], object)
    a = b[300:700]
    d = np.square(a[:, None] - b[None]).sum(axis=2)
    d[np.arange(400), np.arange(300, 700)] = np.inf
    reach = np.sqrt(np.sort(d, axis=1)[:, 3]) if known else np.full(400, np.inf)
    row, place, squared = neighbours._k_within(ids, a, reach, others, b, 4)
    for i in range(400):
        wanted = sorted(range(900), key=lambda j: (d[i, j], others[j]))[:4]
        assert place[row == i].tolist() == wanted and np.allclose(squared[row == i], d[i, wanted])
    missing = np.concatenate([b, [[np.nan] * 3]])
    assert not len(neighbours._k_within(ids, a, reach, np.append(others, "none"), missing, 4)[0])


def test_full_search_moves_rows_a_fixed_number_of_times(spark, monkeypatch):
    # 64 features without any structure: nothing can be ruled out
    moved, blocks = [], neighbours._in_every_block

    def count(df, *rest):
        out = blocks(df, *rest)
        moved.append(out.count())
        return out

    monkeypatch.setattr(neighbours, "_in_every_block", count)
    rng, sizes = np.random.default_rng(9), (480, 1920)
    for n in sizes:
        x = rng.normal(size=(n, 64))
        df = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(x)], "vec string, x array<double>")
        assert neighbours.nearest(df, 3, block_rows=20, directions=1).count() == 3 * n
    half = len(moved) // 2
    assert sum(moved[half:]) < 6 * sum(moved[:half])


def test_tomek_links_match_brute_force(spark):
    x, y, df = vectors(spark)
    n = len(x)

    def nearest(i):
        d = ((x - x[i]) ** 2).sum(1)
        return min((j for j in range(n) if j != i), key=lambda j: (d[j], d[j] == 0 and y[i] != y[j], str(j)))

    near = [nearest(i) for i in range(n)]
    wanted = {tuple(sorted((str(i), str(near[i])))) for i in range(n) if near[near[i]] == i and y[i] != y[near[i]]}
    got = {tuple(sorted(r)) for r in balance.tomek_links(df, "id", list("abc"), block_rows=30).collect()}
    assert got == wanted
    kept = balance.remove_tomek_links(df, "id", list("abc"), block_rows=30)
    assert kept.count() == n - 2 * len(wanted)


def test_oversampling(spark):
    x, y, df = vectors(spark)
    got = balance.oversample(df, "id", list("abc"), k=3, block_rows=30).toPandas()
    assert (got.y == 1).sum() == (got.y == 0).sum() == (y == 0).sum()
    assert got.id.is_unique
    minority = {i: x[i] for i in range(len(x)) if y[i] == 1}
    synthetic = got[got.id.str.contains("#")]
    assert len(synthetic) == (y == 0).sum() - (y == 1).sum()
    for r in synthetic.itertuples():
        parent = minority[int(r.id.split("#")[0])]
        point = np.array([r.a, r.b, r.c])
        others = sorted((v for i, v in minority.items() if i != int(r.id.split("#")[0])), key=lambda v: ((v - parent) ** 2).sum())
        reach = ((others[2] - parent) ** 2).sum()
        # on the segment to a neighbour no farther than the third nearest
        assert any(
            ((v - parent) ** 2).sum() <= reach
            and abs(math.dist(parent, point) + math.dist(point, v) - math.dist(parent, v)) < 1e-9
            for v in others
        )


def separable(spark, n=240, seed=8):
    rng = np.random.default_rng(seed)
    y = (rng.random(n) < 0.3).astype(int)
    rows = [
        (f"f{i}", float(y[i] * 6 + rng.normal()), float(rng.normal()), float(y[i] * 3 + rng.normal()), "BUGGY" if y[i] else "CLEAN")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "file_path string, added_lines double, deleted_lines double, nloc double, label string")


@pytest.mark.parametrize("name", ["merged.csv", "merged.parquet"])
def test_merged_training_set_is_written(spark, name):
    path = scratch(spark, "test") + "/" + name
    base, new = separable(spark, 90, 1), separable(spark, 40, 2).withColumn("extra", F.lit(1.5))
    merged, sizes, warnings = merge(new, base, path)
    assert sizes == {"base": 90, "new": 40, "merged": 130} and warnings == []
    wanted = aligned_union(base, new)
    back = read_labelled(spark, path).select(*wanted.columns)
    assert merged.columns == wanted.columns
    for read in (back, merged):
        typed = read.select(*(F.col(c).cast(wanted.schema[c].dataType).alias(c) for c in wanted.columns))
        assert typed.exceptAll(wanted).count() == 0 and typed.count() == 130
    assert "very small (40 rows)" in merge(new, None)[2][0] and merge(base, None)[2] == []
    assert merge(new.limit(0), base)[2] == ["the dataset has no rows, only its base is used"]
    config = TrainingConfig(selection=None, balance=False, settings=SMALL, models=["Naive Bayes"], merged_to=path)
    result = run_training(new, config, base)
    assert result.sizes["merged"] == 130 and read_labelled(spark, path).count() == 130


def test_training_end_to_end(spark):
    path = scratch(spark, "test-models")
    config = TrainingConfig(
        selection="selectkbest", settings=SMALL, save_to=path,
        models=["Logistic Regression", "Decision Tree", "Random Forest", "Gradient Boosting", "Naive Bayes"],
    )
    result = run_training(separable(spark), config)
    table = result.metrics.orderBy("position").collect()
    assert [r.f1 for r in table] == sorted((r.f1 for r in table), reverse=True)
    assert table[0].f1 > 0.9 and len(table) == 6
    assert {r.model_name for r in table} >= {training.ENSEMBLE}
    n = {r.tp + r.tn + r.fp + r.fn for r in table}
    assert len(n) == 1

    loaded = model_store.load_models(spark, path)
    assert {m.name for m in loaded} == {m.name for m in result.models}
    rows = separable(spark, 50, 9).withColumn("nloc", F.when(F.col("nloc") > 3, float("nan")).otherwise(F.col("nloc")))
    fresh = scoring.score(rows, result.models, keep=["file_path"])
    stored = scoring.score(rows, loaded, keep=["file_path"])
    assert fresh.exceptAll(stored).count() == 0 and fresh.count() == 50 * 6
    only = scoring.score(rows, loaded, training.ENSEMBLE, keep=["file_path"])
    assert only.exceptAll(stored.filter(F.col("name") == training.ENSEMBLE)).count() == 0
    members = next(m for m in loaded if m.members).members
    mean = scoring.ensemble_mean(stored, ["file_path"], members).withColumn("p", F.round("probability", 9))
    assert mean.join(only.withColumn("q", F.round("probability", 9)).select("file_path", "q"), "file_path").filter("p <> q").count() == 0
    with pytest.raises(ValueError):
        scoring.choose(loaded, "no such model")
    registry = model_store.read_registry(spark, path)
    assert registry.filter("model_id = 'ensemble_top_3_'").count() == 1

    # the same rows arriving as a stream get the same scores
    folder = scratch(spark, "arriving")
    rows.write.parquet(f"{folder}/rows.parquet")
    stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/rows.parquet")
    streamed = jobs.run_available(scoring.score(stream, loaded, keep=["file_path"]), "scored")
    assert streamed.exceptAll(stored).count() == 0 and streamed.count() == stored.count()


def test_missing_features_count_as_zero(spark):
    df = separable(spark, 60).withColumn("y", datasets.binary_label())
    models = training.fit_models(df, ["added_lines", "nloc"], ["Naive Bayes"])
    without = scoring.score(df.drop("nloc"), models, keep=["file_path"])
    zeros = scoring.score(df.withColumn("nloc", F.lit(0.0)), models, keep=["file_path"])
    assert without.exceptAll(zeros).count() == 0


def test_offline_preset(spark):
    from dataclasses import replace

    config = replace(OFFLINE, settings=SMALL, models=["Logistic Regression", "Naive Bayes", "Decision Tree"])
    result = run_training(separable(spark, 120), config)
    assert result.leakage.first().verdict in ("leakage", "possible leakage", "realistic")
    assert result.features == ["added_lines", "deleted_lines", "nloc", "total_changes", "net_lines", "code_churn"]


def test_reports(spark):
    rows = [("f", "g", "b", 0.3, 1, 4), ("f", "g", "a", 0.8, 1, 4), ("f", "g", "a", 0.1, 7, 9)]
    df = spark.createDataFrame(
        [(a, b, n, n + "_1", p, "BUGGY" if p >= 0.5 else "CLEAN", s, e) for a, b, n, p, s, e in rows],
        "filename string, function_name string, name string, model_id string, probability double, label string, function_start_line int, function_end_line int",
    )
    first = reporting.first_predictions(df, ["filename", "function_name", "name"], ["function_start_line"])
    assert first.count() == 2
    shown = reporting.result_rows(first).orderBy("model").collect()
    assert [(r.function_lines, r.risk_band) for r in shown] == [("1-4", "red"), ("1-4", "yellow")]
    assert reporting.sort_results(df, "name", ascending=False).first().name == "b"
    counted = reporting.prediction_counts(df, ["filename", "function_name"]).first()
    assert (counted.prediction_count, counted.function_count) == (3, 1)
    top = reporting.top_importances(spark.createDataFrame([("a_b", 0.5), ("c", 0.25)], "feature string, importance double"))
    assert [(r.label, r.width) for r in top.orderBy(F.desc("width")).collect()] == [("A B", 100.0), ("C", 50.0)]


def test_bound_keeps_rare_classes(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), (F.col("id") % 1000 == 0).cast("int").alias("y"))
    sizes = {r.y: r["count"] for r in sampling.bounded(df, 1000).groupBy("y").count().collect()}
    assert sizes[1] == 20 and 880 < sizes[0] < 1080
    even = df.withColumn("y", (F.col("row_id") % 4 == 0).cast("int"))
    sizes = {r.y: r["count"] for r in sampling.bounded(even, 1000).groupBy("y").count().collect()}
    assert all(400 < n < 600 for n in sizes.values())
    assert sampling.bounded(df, None) is df and sampling.bounded(df, 20_000) is df


def test_statistics_come_from_all_training_rows(spark, monkeypatch):
    seen = {"scores": [], "fits": []}
    scores, forest = selection.anova_scores, selection._forest
    monkeypatch.setattr(selection, "anova_scores", lambda df, f: seen["scores"].append(df.count()) or scores(df, f))
    monkeypatch.setattr(selection, "_forest", lambda df, *a: seen["fits"].append(df.count()) or forest(df, *a[:1], 2, 1, 2))
    config = TrainingConfig(selection="selectkbest", models=["Naive Bayes"], max_fit_rows=60, balance=False)
    run_training(separable(spark), config)
    assert 160 < seen["scores"][0] < 180
    rows = separable(spark).select("*", F.monotonically_increasing_id().alias("row_id"))
    rows, columns = datasets.prepare(rows, keep=["row_id"])
    selection.select_best_method(rows, columns, ("selectkbest", "importance"), max_fit_rows=60)
    assert seen["scores"][1] > 180 and len(seen["fits"]) == 3 and max(seen["fits"]) < 100


def test_bounded_forests_are_fitted_by_few_tasks(spark, monkeypatch):
    tasks, forest = [], selection._forest
    monkeypatch.setattr(
        selection, "_forest", lambda df, *a: tasks.append(df.rdd.getNumPartitions()) or forest(df, *a[:1], 2, 1, 2)
    )
    rows = separable(spark).select("*", F.monotonically_increasing_id().alias("row_id"))
    rows, columns = datasets.prepare(rows.repartition(40), keep=["row_id"])
    selection.select_best_method(rows, columns, ("selectkbest", "importance"), max_fit_rows=60)
    assert len(tasks) == 3 and max(tasks) <= selection.FIT_TASKS


def test_best_feature_method_fits_on_all_training_rows(spark, monkeypatch, tmp_path):
    n, fits, forest = 26_000, [], selection._forest
    monkeypatch.setattr(selection, "_forest", lambda df, *a: fits.append(df.count()) or forest(df, *a[:1], 2, 1, 2))
    spark.range(n).selectExpr("id AS doc_id", "repeat('a b ', cast(id % 97 as int)) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(0, n, 2).selectExpr("id AS doc_id", "cast(id % 97 > 50 as int) AS quality").write.parquet(f"{tmp_path}/labels.parquet")
    assert catalog.QUERIES["best_feature_method"](spark, str(tmp_path)).count() > 0
    assert len(fits) >= 3 and all(abs(f - 0.8 * n) <= 1 for f in fits)


def test_texts_do_not_move_to_their_labels(spark, tmp_path):
    spark.createDataFrame([(1, "a b\nc"), (2, None), (2, "d")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(2, 0), (2, 1), (None, 0)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = catalog._document_rows(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, line in enumerate(plan) if "Join LeftOuter" in line)
    assert "length(text" in plan[join + 1]
    got = sorted((r.row_id, r.nloc, r.token_count, r.label) for r in rows.fillna(-1).collect())
    assert got[0] == (1, 2, 3, "CLEAN") and len(got) == 5
    assert [r[3] for r in got[1:]] == ["BUGGY", "CLEAN"] * 2


def test_boosted_presets_fit(spark):
    boosted = [f"Boosted Trees {x}" for x in "ABC"]
    few = {name: {"maxIter": 3, "maxDepth": 3} for name in boosted}
    models = run_training(separable(spark), TrainingConfig(selection=None, settings=few, models=boosted)).models
    assert {m.name for m in models} == {*boosted, training.ENSEMBLE}
    assert all(m.metrics["f1"] > 0.9 for m in models)
    assert all(m.pipeline.stages[-1].getNumTrees == 3 for m in models if m.pipeline)


def test_queries_fit_every_preset(spark, monkeypatch):
    fitted, fit = [], training.fit_models

    def quick(train, features, names=None, *rest):
        fitted.append(names or training.MODEL_NAMES)
        return fit(train, features, ["Logistic Regression", "Decision Tree", "Naive Bayes"])

    monkeypatch.setattr(training, "fit_models", quick)
    for name in ("trained_models", "saved_models"):
        assert catalog.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 4
    assert fitted == [training.MODEL_NAMES] * 2


def test_models_of_the_same_rows_are_trained_once(spark):
    df = separable(spark).withColumn("y", (F.col("label") == "BUGGY").cast("int")) if "y" not in separable(spark).columns else separable(spark)
    calls, features = [], [c for c, t in df.dtypes if t == "double"][:2]

    def train():
        calls.append(1)
        models = training.fit_models(df, features, ["Naive Bayes"])
        return training.measure(df, models)

    name = f"test{random.random()}".replace(".", "")
    first = model_store.trained_once(df, name, train)
    again = model_store.trained_once(df.repartition(5), name, train)
    assert len(calls) == 1 and [m.name for m in again] == [m.name for m in first] == ["Naive Bayes"]
    model_store.trained_once(df.limit(5), name, lambda: train())
    assert len(calls) == 2


def test_predictions_of_a_function_meet_without_a_second_shuffle(spark, tmp_path):
    from faultline.plans import catalog

    rows = [(k % 9, k * 7 % 5, k % 3, float(k % 50), k * 997.0, k % 10 / 10, "R" if k % 2 else "N") for k in range(300)]
    layout = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_returnflag string"
    lines = spark.createDataFrame([*rows, (None, 1, 1, 1.0, 1.0, 0.1, "R")], layout)
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    found = catalog.QUERIES["predictions_by_function"](spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    first = {}
    for o, p, n, quantity, price, discount, y in rows + [(None, 1, 1, 1.0, 1.0, 0.1, "R")]:
        for model, name, raw in (("a_1", "Quantity", quantity / 50), ("b_1", "Discount", discount * 10), ("c_1", "Price", price / 100000), ("c_2", "Price", price / 90000)):
            score = max(0.0, min(1.0, raw))
            row = (model, p % 100 + 1, p % 100 + int(quantity), int(y == "R"), "BUGGY" if score >= 0.5 else "CLEAN", score)
            key = (None if o is None else f"order{o}", f"item_{n}", name)
            first[key] = min(first.get(key, row), row)
    wanted = {}
    for (file, function, name), row in first.items():
        wanted.setdefault((file, function), []).append((row, name))
    assert {(r[0], r[1]): (r[2], r[3]) for r in found.collect()} == {
        key: (min(of)[0][1], ",".join(sorted(f"{name}={row[4]}" for row, name in of))) for key, of in wanted.items()
    }
    shown = catalog.QUERIES["result_rows"](spark, str(tmp_path))
    assert "Aggregate" not in shown._jdf.queryExecution().executedPlan().toString()  # sorting reads a table
    assert shown.count() == sum(row[4] == "BUGGY" for row in first.values())
