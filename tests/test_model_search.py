"""Linear grids from moments against Spark's own solver, and boosting that stops when it brings no gain."""

import numpy as np
import pytest
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import functions as F

from oddlot.columns import ID
from oddlot.detectors import dense_net as nets
from oddlot.plans import model_search as ms


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(5)
    u = rng.normal(1e4, 3, 600)
    v = u / 3 + rng.normal(0, 1, 600)
    w = rng.normal(0, 50, 600)
    t = 2 * u - 5 * v + 0.01 * w + rng.normal(0, 2, 600)
    rows = [(i, *map(float, r), 7.0) for i, r in enumerate(zip(u, v, w, t))]
    df = spark.createDataFrame(rows, f"{ID} long, u double, v double, w double, t double, flat double")
    return ms.with_folds(ms.assembled(df, ["u", "v", "w", "flat"], "t")).persist()


@pytest.mark.parametrize("params", [
    {}, {"regParam": 0.3}, {"regParam": 0.3, "elasticNetParam": 0.5}, {"regParam": 1.5, "elasticNetParam": 1.0},
])
def test_linear_model_equals_sparks(training, params):
    ours = ms.solve_linear(ms.merged(list(ms.fold_moments(training).values())), **params)
    spark_fit = LinearRegression(featuresCol="x", labelCol="y", solver="normal", tol=1e-12, maxIter=1000, **params)
    theirs = spark_fit.fit(training.drop("flat"))
    assert np.allclose(ours.weights, theirs.coefficients.toArray(), rtol=1e-4, atol=1e-5)
    assert ours.weights[3] == 0
    ours, theirs = ms.mse(ours.transform(training)), ms.mse(theirs.transform(training))
    assert ours == pytest.approx(theirs, rel=1e-5)


def test_linear_grid_needs_one_aggregate_and_equals_refits(training):
    grid = {"regParam": [0.0, 0.5], "elasticNetParam": [0.0, 0.8]}
    board, best = ms.grid_search("glm", training, grid)
    found = {r["params"]: r["mse"] for r in board.collect()}
    assert len(found) == 4 and best.cv_mse == min(found.values())
    moments = ms.fold_moments(training)
    for params in ms._combos(grid):
        errors = []
        for fold in range(ms.FOLDS):
            model = ms.solve_linear(ms.merged([m for f, m in moments.items() if f != fold]), **params)
            held = training.where(F.col("fold") == fold)
            errors.append(ms.mse(model.transform(held)))
            assert ms.linear_error(model, moments[fold]) == pytest.approx(errors[-1], rel=1e-8)
        assert found[str(params)] == pytest.approx(np.mean(errors), rel=1e-8)


def test_linear_model_of_a_constant_label_or_null_labels(spark, training):
    flat = ms.fold_moments(training.withColumn("y", F.lit(3.0)))
    found = ms.solve_linear(ms.merged(list(flat.values())))
    assert found.weights == (0.0, 0.0, 0.0, 0.0) and found.intercept == pytest.approx(3.0)
    gaps = training.withColumn("y", F.when(F.col(ID) % 3 > 0, F.col("y")))
    some = ms.merged(list(ms.fold_moments(gaps).values()))
    kept = ms.merged(list(ms.fold_moments(training.where(F.col(ID) % 3 > 0)).values()))
    assert some.n == kept.n == 400 and np.allclose(some.products, kept.products)


def test_rounds_that_count():
    assert ms.kept_rounds([5, 4, 3, 3, 3], 2) == (3, True)
    assert ms.kept_rounds([5, 4, 3, 3.5, 2], 2) == (5, False)
    assert ms.kept_rounds([5, 6, 7, 1], 2) == (1, True)
    assert ms.kept_rounds([9], 2) == (1, False)


def test_boosting_stops_early_and_keeps_the_first_trees(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(a), float(a > 0) * 4 + float(e)) for i, (a, e) in enumerate(zip(*rng.normal(size=(2, 900))))]
    df = spark.createDataFrame(rows, f"{ID} long, a double, t double")
    train = ms.with_folds(ms.assembled(df, ["a"], "t")).persist()
    params = {"maxDepth": 5, "maxIter": 400, "stepSize": 0.5}
    curve = ms.boosting_curve(train, params, patience=3).orderBy("round").collect()
    errors = [r["mse"] for r in curve]
    assert len(errors) < 400 and errors.index(min(errors)) + 1 >= sum(r["kept"] for r in curve)
    found = ms.fit_boosted(train, params, patience=3)
    assert found.rounds == sum(r["kept"] for r in curve) == found.model.getNumTrees
    aside = ms.mse(found.model.transform(train.where("stop")))
    assert aside == pytest.approx(errors[found.rounds - 1])


def test_boosting_without_rows_set_aside_uses_all_rounds(spark):
    df = spark.range(60).select(F.col("id").alias(ID), F.col("id").cast("double").alias("a"))
    train = ms.assembled(df, ["a"], "a").withColumn("stop", F.lit(False))
    found = ms.fit_boosted(train, {"maxIter": 3})
    assert found.rounds == found.model.getNumTrees == 3 and found.curve == []


def test_trees_over_cells_equal_sparks_trees_over_rows(spark):
    rng = np.random.default_rng(8)
    many, few, noise = rng.normal(size=4000).round(2), rng.integers(0, 5, 4000), rng.normal(size=4000)
    rows = [(i, float(a), int(b), float(np.sin(2 * a) * b + e)) for i, (a, b, e) in enumerate(zip(many, few, noise))]
    df = spark.createDataFrame(rows, f"{ID} long, a double, b int, t double")
    train = ms.with_folds(ms.assembled(df, ["a", "b"], "t")).persist()
    params = {"maxDepth": 3, "maxIter": 12}
    found = ms.fit_boosted(train, params, patience=12)
    fitted, aside = train.where("not stop"), train.where("stop")
    plain = GBTRegressor(featuresCol="x", labelCol="y", seed=ms.SEED, **params).fit(fitted)
    assert found.curve == pytest.approx(plain.evaluateEachIteration(aside, "squared"), rel=1e-9)
    ours = [r["prediction"] for r in found.model.transform(train).orderBy(ID).collect()]
    plain = GBTRegressor(featuresCol="x", labelCol="y", seed=ms.SEED, **{**params, "maxIter": found.rounds}).fit(fitted)
    assert ours == pytest.approx([r["prediction"] for r in plain.transform(train).orderBy(ID).collect()], rel=1e-9)
    board, _ = ms.grid_search("gbt", train, {"maxDepth": [3], "maxIter": [12]})
    errors = []
    for fold in range(ms.FOLDS):
        part, held = fitted.where(F.col("fold") != fold), train.where(F.col("fold") == fold)
        one = GBTRegressor(featuresCol="x", labelCol="y", seed=ms.SEED, **params).fit(part)
        rounds, _ = ms.kept_rounds(list(one.evaluateEachIteration(aside.where(F.col("fold") != fold), "squared")))
        errors.append(one.evaluateEachIteration(held, "squared")[rounds - 1])
    assert board.first()["mse"] == pytest.approx(np.mean(errors), rel=1e-9)


def test_trees_see_cells_of_rows(spark):
    """Before, every round went over all rows; now their number does not matter to it."""
    df = spark.range(40_000).select(F.col("id").alias(ID), (F.col("id") % 7919).cast("double").alias("a"))
    plain = ms._plain(ms.assembled(df, ["a"], "a"), ID)
    cuts = ms._all_borders(plain, 40_000, 32, ID)
    cells = ms._cells(plain, cuts).agg(F.sum("n").alias("n"), F.count("*").alias("cells")).first()
    assert cells["n"] == 40_000 and cells["cells"] == len(cuts[0]) + 1 <= 32


def test_borders_of_bins():
    assert ms.borders([(1.0, 5), (2.0, 1), (4.0, 1)], 3) == [1.5, 3.0]
    assert ms.borders([(float(i), 1) for i in range(8)], 4) == [1.5, 3.5, 5.5]
    assert ms.borders([(0.0, 90), (1.0, 5), (2.0, 5)], 2) == [0.5]
    assert ms.borders([(3.0, 4)], 32) == [] == ms.borders([], 32)


@pytest.mark.parametrize("shard_rows", [100, 10_000])
def test_nets_of_all_folds_are_trained_in_one_pass_as_if_alone(training, monkeypatch, shard_rows):
    monkeypatch.setattr(nets, "ROWS_PER_SHARD", shard_rows)
    passes, one = [], nets._one_epoch

    def counted(*args):
        passes.append(1)
        return one(*args)

    monkeypatch.setattr(nets, "_one_epoch", counted)
    train, grid = training.where(F.col(ID) != 3), [(4,), (3, 2)]
    found = ms.fit_fold_nets(train, ["u", "v", "w"], grid, 2)
    assert len(passes) == 2 and len(found) == 10
    for (widths, fold), model in list(found.items())[1::4]:
        alone = ms.fit_scaled_net(train.where(F.col("fold") != fold), ["u", "v", "w"], widths, 2)
        assert np.allclose(list(model.scale.values()), list(alone.scale.values()), rtol=1e-9)
        assert np.allclose(model.net.weights, alone.net.weights, rtol=1e-5, atol=1e-6)


def test_boosting_refuses_missing_labels(training):
    gaps = training.withColumn("y", F.when(F.col(ID) % 3 > 0, F.col("y")))
    with pytest.raises(Exception, match="Labels MUST NOT be Null or NaN"):
        ms.fit_boosted(gaps, {"maxIter": 2})
