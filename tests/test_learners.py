"""Learners against brute force, and their quality and determinism."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, CUSTOMER, ID, MERCHANT
from oddlot.detectors import dense_net as nets
from oddlot.detectors import isolation
from oddlot.operators import boxes, clusters, noise, rfm
from oddlot.plans import model_search, score_run
from oddlot.plans.feature_run import run_features, score_columns
from oddlot.plans.registry import lines
from oddlot.session import settle
from oddlot.sources.segments import inject_anomalies, merchant_segments
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0.3, 0.05, (220, 3)), rng.uniform(0, 1, (60, 3))]).round(2)
    x = np.concatenate([x, np.repeat(x[:1], 25, axis=0)])
    df = spark.createDataFrame(
        [(i, *map(float, r)) for i, r in enumerate(x)], "PaymentTransactionId long, a double, b double, c double"
    )
    return x, df.persist()


def distances(x):
    square = sum((x[:, None, i] - x[None, :, i]) ** 2 for i in range(x.shape[1]))
    return np.sqrt(square)


def brute_noise(x, eps, min_samples):
    near = distances(x) <= eps
    core = near.sum(axis=1) >= max(1, min_samples)
    return ~(near & core[None, :]).any(axis=1)


@pytest.mark.parametrize("block", [4, 512])
@pytest.mark.parametrize("eps, min_samples", [(0.05, 5), (0.1, 12), (0.4, 150), (0.03, 1)])
def test_noise_equals_brute_force(cloud, monkeypatch, block, eps, min_samples):
    monkeypatch.setattr(boxes, "BLOCK", block)
    x, df = cloud
    rows = noise.with_noise(df, ["a", "b", "c"], eps, min_samples).orderBy(ID).collect()
    assert [r["noise"] for r in rows] == brute_noise(x, eps, min_samples).tolist()


def test_sweeps_equal_brute_force(cloud, monkeypatch):
    monkeypatch.setattr(boxes, "BLOCK", 16)
    x, df = cloud
    sweep = noise.sweep_min_samples(df, ["a", "b", "c"], len(x)).collect()
    assert [(r["m_s"], r["outliers"]) for r in sweep] == [
        (s, int(brute_noise(x, noise.SHARES_EPS, s).sum())) for s in noise.min_sample_grid(len(x))
    ]
    sweep = noise.sweep_eps(df, ["a", "b", "c"], 15).collect()
    assert [r["outliers"] for r in sweep] == [int(brute_noise(x, e, 15).sum()) for e in noise.EPS_GRID]
    counts = [r["outliers"] for r in sweep]
    assert counts == sorted(counts, reverse=True)


def test_tune_and_predict(cloud):
    x, df = cloud
    names = ["a", "b", "c"]
    params = noise.tune(df, names, divisors=[2, 3])
    po = x[(x >= x.mean(axis=0)).all(axis=1)]
    assert params["min_samples"] in noise.min_sample_grid(len(po))
    assert params["optimum_divison"] in (2, 3)
    out = noise.predict(df, names, {**params, "eps": 0.3}).orderBy(ID).collect()
    kept = (x >= x.mean(axis=0) / 14).all(axis=1)
    expected = np.zeros(len(x), dtype=int)
    n = int(kept.sum())
    expected[np.nonzero(kept)[0][brute_noise(x[kept], 0.3, n - int(0.01 * n))]] = -1
    assert [r["label_dbscan"] for r in out] == expected.tolist()


def test_mixture_follows_expectation_maximisation(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(m, s, (80, 2)) for m, s in ((0, 1), (8, 0.5), (20, 2), (-9, 1))])
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "customer_id long, p double, q double")
    model = clusters.fit_mixture(df, ["p", "q"])
    assert sorted(np.round([m[0] for m in model.means])) == [-9, 0, 8, 20]
    assert sum(model.weights) == pytest.approx(1)
    rows = clusters.with_responsibilities(df, model).collect()
    assert all(sum(r["responsibility"]) == pytest.approx(1) for r in rows)
    logs = clusters._log_densities(model, x)
    assert [r["label"] for r in rows] == logs.argmax(axis=1).tolist()


def test_mixture_does_not_depend_on_partitions(spark):
    df = spark.range(3000).select((F.col("id") % 17 + F.rand(3)).alias("p"), F.sin("id").alias("q"))
    df = settle(df.unionByName(df.limit(1).select(F.lit(None).cast("double").alias("p"), "q")))
    found = [clusters.fit_mixture(df.repartition(n), ["p", "q"]) for n in (1, 3, 11)]
    assert found[0] == found[1] == found[2]


def test_mixture_with_few_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 5.0)], "customer_id long, p double")
    assert len(clusters.fit_mixture(df, ["p"]).weights) == 2
    assert clusters.fit_mixture(df.limit(0), ["p"]) is None


def test_clusters_do_not_depend_on_partitions(spark):
    df = lines(spark, SMALL)
    usual = clusters.cluster_merchants(df).orderBy(MERCHANT).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert clusters.cluster_merchants(df.repartition(7)).orderBy(MERCHANT).collect() == usual
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_sweep_is_capped_at_distinct_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 1.0), (3, 4.0)], "k long, p double")
    table, fits = clusters.sweep_k(df, ["p"])
    assert sorted(fits) == [1, 2]
    assert table.where("k = 1").first()["distance"] == pytest.approx(4 / 3)


def plain_kmeans(points, k):
    """Farthest-point seeds and exact rounds, one point at a time."""
    square = lambda p, q: sum((a - b) * (a - b) for a, b in zip(p, q))
    mean = lambda rows: tuple(sum(map(Fraction, c)) / len(rows) for c in zip(*rows))
    seeds = [min(points, key=lambda p: (-square(p, mean(points)), p))]
    while len(seeds) < k:
        seeds.append(min(points, key=lambda p: (-min(square(p, s) for s in seeds), p)))
    centers = seeds
    while True:
        groups = [[] for _ in centers]
        for p in points:
            groups[min(range(k), key=lambda i: (square(p, centers[i]), i))].append(p)
        moved = [mean(g) if g else c for g, c in zip(groups, centers)]
        if moved == centers:
            return sorted(tuple(map(float, c)) for c in centers)
        centers = moved


def test_kmeans_equals_plain_rounds(spark):
    rng = np.random.default_rng(8)
    # Eighths are whole numbers at the fixed scale; ties and repeats are common among them.
    x = np.concatenate([rng.integers(0, 40, (60, 2)), rng.integers(100, 120, (30, 2)), np.full((40, 2), 7)]) / 8
    df = spark.createDataFrame([(*map(float, r),) for r in x], "p double, q double")
    found = clusters.kmeans(df.repartition(5), ["p", "q"], range(1, 6))
    points = [tuple(map(float, r)) for r in x]
    for k in range(1, 6):
        assert [tuple(c) for c in found[k]] == [pytest.approx(c) for c in plain_kmeans(points, k)]
    assert clusters.kmeans(df.repartition(1), ["p", "q"], range(1, 6)) == found


def test_kmeans_passes_over_rows_that_lack_a_number(spark):
    rows = [(1.0, 2.0), (3.0, 4.0), (None, 1.0), (float("nan"), 1.0), (float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "p double, q double")
    assert clusters.kmeans(df, ["p", "q"], [1, 2, 3]) == {1: [[2.0, 3.0]], 2: [[1.0, 2.0], [3.0, 4.0]]}
    assert clusters.kmeans(df.limit(0), ["p", "q"], [1, 2]) == {}


@pytest.fixture(scope="module")
def injected(spark):
    df = lines(spark, SMALL)
    out = inject_anomalies(df, merchant_segments(df.select(MERCHANT), seed=7))
    return settle(out.withColumn("size", F.log1p(AMOUNT)))


def test_injection_leaves_the_segments_of_the_customer(spark, injected):
    segments = merchant_segments(lines(spark, SMALL).select(MERCHANT), seed=7)
    n = injected.count()
    share = injected.where("is_injected = 1").count() / n
    assert 0.13 < share < 0.2 and n == lines(spark, SMALL).count()
    moved = injected.where("is_injected = 1").join(segments, MERCHANT)
    most = moved.groupBy(CUSTOMER).agg(F.countDistinct("segment").alias("s")).agg(F.max("s")).first()[0]
    assert most <= 3


@pytest.mark.parametrize("extended", [False, True])
def test_injected_rows_score_higher(injected, extended):
    nodes = isolation.fit_forest(injected, ["size", AMOUNT], trees=50, extended=extended).persist()
    scored = isolation.with_anomaly_score(injected, nodes, ["size", AMOUNT], "s")
    mean = {r["is_injected"]: r["s"] for r in scored.groupBy("is_injected").agg(F.avg("s").alias("s")).collect()}
    assert mean[1] > mean[0]


def test_forest_size_and_contamination(injected):
    nodes = isolation.fit_forest(injected, ["size"], trees=20, sample_rows=64).persist()
    roots = nodes.where("node = 0")
    assert roots.count() == 20 and {r["size"] for r in roots.collect()} == {64}
    assert nodes.groupBy("tree").count().agg(F.max("count")).first()[0] <= 2 * 64 - 1
    labelled = isolation.with_forest_label(injected, injected, nodes, ["size"], contamination=0.01)
    n = injected.count()
    # Tied scores at the cut stay on the inner side.
    assert labelled.where("label_iso = -1").count() <= np.ceil(0.01 * n)


def test_samples_are_exact_in_every_regime(spark):
    df = spark.range(5000).select(F.col("id").alias(ID), F.rand(1).alias("x"))
    for trees, rows in ((3, 20), (40, 200), (200, 256), (200, 1), (200, 2), (200, 10)):
        drawn = isolation.tree_samples(df, ["x"], ID, 5000, trees, rows, 1)
        sizes = [r["count"] for r in drawn.groupBy("tree").count().collect()]
        assert len(sizes) == trees and set(sizes) == {rows}
        assert drawn.select("tree", ID).distinct().count() == trees * rows


def test_forest_does_not_depend_on_partitions(spark, injected):
    def table(df):
        return isolation.fit_forest(df, ["size"], trees=5, sample_rows=32).drop("normal").orderBy("tree", "node").collect()

    assert table(injected) == table(injected.repartition(7))


def test_gradient_matches_differences():
    for net in (nets.symmetric_net(3, (4, 2)), nets.halving_net(3, 2, 4, 0.01), nets.regression_net(3, (4,))):
        rng = np.random.default_rng(0)
        w = nets.initial_weights(net, 1).astype(float) + 0.05
        x = rng.uniform(0, 1, (6, 3))
        y = x if net.sizes[-1] == 3 else x[:, :1]

        def loss(v):
            outputs = nets.forward(net, v, x)
            error = outputs[-1] - y
            base = np.abs(error).mean() if net.loss == "mae" else (error**2).mean()
            return base + sum(net.l1 * np.abs(o).sum() / len(x) for o in outputs[1 : 1 + net.penalised])

        grad, _ = nets._gradient(net, w, x, y)
        for i in range(0, len(w), 3):
            step = np.zeros_like(w)
            step[i] = 1e-6
            assert grad[i] == pytest.approx((loss(w + step) - loss(w - step)) / 2e-6, abs=2e-4)


def test_halving_widths():
    assert nets.halving_widths() == (32, 16, 8, 4)
    assert nets.symmetric_net(5).sizes == (5, 1000, 500, 100, 50, 10, 5, 5, 10, 50, 100, 500, 1000, 5)


def test_autoencoder_learns_and_round_trips(spark, cloud, monkeypatch):
    monkeypatch.setattr(nets, "ROWS_PER_SHARD", 100)
    _, df = cloud
    names = ["a", "b", "c"]
    net, history = nets.fit_net(df, nets.symmetric_net(3, (16, 8)), names, epochs=15, batch=16)
    losses = [r["train_loss"] for r in history.orderBy("epoch").collect()]
    assert losses[-1] < 0.6 * losses[0]
    again, _ = nets.fit_net(df.repartition(5), nets.symmetric_net(3, (16, 8)), names, epochs=15, batch=16)
    assert np.allclose(again.weights, net.weights, atol=1e-5)
    loaded = nets.net_from_table(nets.weights_table(spark, net))
    assert loaded == net and np.allclose(loaded.weights, net.weights)
    scored = nets.with_reconstruction_error(df, net, names)
    inner = scored.where(f"{ID} < 220").agg(F.avg("anomaly_ae_values")).first()[0]
    outer = scored.where(f"{ID} between 220 and 279").agg(F.avg("anomaly_ae_values")).first()[0]
    assert outer > inner


def test_an_epoch_moves_as_many_vectors_as_trainers(spark, cloud, monkeypatch):
    monkeypatch.setattr(nets, "ROWS_PER_SHARD", 10)
    _, df = cloud
    names, net = ["a", "b", "c"], nets.symmetric_net(3, (4,))
    moved, trained = [], nets._trained

    def counted(*args):
        out = trained(*args).persist()
        moved.append(out.count())
        return out

    monkeypatch.setattr(nets, "_trained", counted)
    for data in (df, df.unionByName(df.withColumn(ID, F.col(ID) + 100_000))):
        nets.fit_net(data, net, names, epochs=1, trainers=3)
    chunks = -(-2 * net.n_weights // nets.CHUNK)
    assert moved == [3 * chunks, 3 * chunks]


def test_nets_without_rows_keep_their_first_weights(spark, cloud):
    _, df = cloud
    net, history = nets.fit_net(df.limit(0), nets.symmetric_net(3, (4,)), ["a", "b", "c"], epochs=2)
    assert np.array_equal(net.weights, nets.initial_weights(net, 0))
    assert [r["train_loss"] for r in history.collect()] == [None, None]


def test_nets_pass_over_rows_that_lack_a_number(spark):
    df = spark.range(500).select(
        F.col("id").alias(ID), F.when(F.col("id") != 7, F.rand(1)).alias("a"), F.lit(0.5).alias("b")
    )
    net, _ = nets.fit_net(df, nets.symmetric_net(2, (4,)), ["a", "b"], epochs=2)
    assert np.isfinite(net.weights).all()
    scored = nets.with_reconstruction_error(df, net, ["a", "b"], "e")
    assert [r[ID] for r in scored.where("e is null").collect()] == [7]


def test_nets_do_not_depend_on_arrow_batches(spark, cloud):
    _, df = cloud
    sizes = []
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for rows in ("10000", "37"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
            net, _ = nets.fit_net(df, nets.symmetric_net(3, (4,)), ["a", "b", "c"], epochs=2, batch=16)
            sizes.append(net.weights)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert np.array_equal(*sizes)


def test_model_search(spark):
    df = spark.range(400).select(
        F.col("id").alias(ID), (F.col("id") % 20).cast("double").alias("u"), F.sin("id").alias("v")
    ).withColumn("t", F.col("u") * 3 + F.col("v"))
    train = model_search.with_folds(model_search.assembled(df, ["u", "v"], "t")).persist()
    assert {r["fold"]: r["count"] for r in train.groupBy("fold").count().collect()} == {i: 80 for i in range(5)}
    board, glm = model_search.grid_search("glm", train, {"regParam": [0.0, 10.0]})
    assert glm.params == {"regParam": 0.0} and board.first()["mse"] == pytest.approx(0, abs=1e-6)
    _, rf = model_search.grid_search("rf", train, {"maxDepth": [3], "numTrees": [5]})
    _, dnn = model_search.grid_dense(train, ["u", "v"], [(4,)], epochs=2)
    ranked = model_search.leaderboard([rf, glm, dnn], train).collect()
    assert ranked[0]["family"] == "glm"
    stack = model_search.stacked_ensemble([rf, dnn], train, ["u", "v"])
    assert model_search.mse(stack.transform(train)) <= 1.5 * min(r["mse"] for r in ranked if r["family"] != "glm")


def test_runs_from_features_to_scores(spark, small_events):
    df = settle(run_features(small_events, "all"))
    names = score_columns("all")
    assert {"c_m_ratios", "c_freq_diff_min_max_p_value", "slope", "gmm"} < set(names) <= set(df.columns)
    assert df.select(ID).distinct().count() == df.count()
    train, test = score_run.split(df, "last")
    options = {"ae": {"widths": (8,), "epochs": 1}, "e_iso_f": {"trees": 10}, "iso_f": {"trees": 10},
               "dbscan": {"divisors": [2]}}
    models = score_run.fit_detectors(df, train, names, "all", options)
    out = score_run.score_detectors(models, df, train, test, names)
    assert out.count() == test.count() > 0
    for spec in score_run.DETECTORS.values():
        assert out.where(F.col(spec.out).isNull()).count() == 0
    alone = {n: m for n, m in models.items() if n != "dbscan"}
    plan = score_run.score_detectors(alone, df, train, test, names)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    with pytest.raises(ValueError):
        score_run.assemble(test, test.union(test).withColumn("z", F.lit(1)), ["z"])


def test_customer_rfm_mean_gap(transactions):
    df = transactions([("a", "m", h, a) for h, a in ((0, 1), (4, 2), (10, 9))] + [("b", "m", 3, 1)])
    assert [tuple(r) for r in rfm.customer_rfm(df).collect()] == [("a", 24.0, 5.0, 2.0)]
