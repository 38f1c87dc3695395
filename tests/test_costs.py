"""What training and scoring hold and move, beside the results."""

import tracemalloc
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, CUSTOMER, ID, MERCHANT, TIME
from oddlot.detectors import dense_net as nets
from oddlot.detectors import isolation
from oddlot.operators import clusters, features, noise, rfm
from oddlot.operators.skew import HotKeys


@pytest.fixture(scope="module")
def cloud(spark):
    return spark.range(600).select(F.col("id").alias(ID), *[F.rand(i).alias(c) for i, c in enumerate("abc")])


def test_trainers_get_each_input_once_and_send_bytes(spark, cloud, monkeypatch):
    names, seen, trained = ["a", "b", "c"], [], nets._trained

    def looked_at(shards, *args):
        out = trained(shards, *args)
        seen.append((shards.dtypes, dict(out.dtypes)["v"]))
        return out

    monkeypatch.setattr(nets, "_trained", looked_at)
    nets.fit_net(cloud, nets.symmetric_net(3, (4,)), names, epochs=1)
    nets.fit_net(cloud, nets.regression_net(2, (4,)), names[:2], names[2:], epochs=1)
    for dtypes, sent in seen:
        assert [t for _, t in dtypes] == ["float"] * 3 and sent == "binary"


def test_forest_scores_hold_no_number_per_row_and_tree():
    rng = np.random.default_rng(3)
    data, trees = rng.random((300, 3)), 300
    data[:40, 1] = 0.0
    names = ["tree", "node", "left", "right", "size", "feature", "threshold", "normal"]
    for extended in (False, True):
        nodes = [n for t in range(trees) for n in isolation._grow(data[rng.choice(300, 30, False)], t, 5, 7, extended)]
        table = pd.DataFrame(nodes, columns=names)
        forest = isolation._forest_arrays(type("Nodes", (), {"toPandas": lambda self: table.copy()})(), 3)
        wide = np.tile(data, (10, 1))
        tracemalloc.start()
        found = isolation._scores(wide, forest)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < len(wide) * trees * 8 / 10
        at = table.set_index(["tree", "node"]).to_dict("index")
        for row in range(0, 300, 60):
            depths = []
            for t in range(trees):
                node, depth = 0, 0
                while (n := at[t, node])["left"] >= 0:
                    side = sum(x * w for x, w in zip(data[row], n["normal"])) if extended else data[row][int(n["feature"])]
                    node, depth = n["left"] if side <= n["threshold"] else n["right"], depth + 1
                depths.append(depth + isolation.rounded_path(n["size"]))
            assert found[row] == pytest.approx(2.0 ** (-np.mean(depths) / isolation.average_path(30)), rel=1e-12)


def test_merchant_ratio_shuffles_rows_once(spark, monkeypatch):
    rows = [(i, None if i % 11 == 0 else i % 7, None if i % 13 == 0 else i % 5) for i in range(300)]
    df = spark.createDataFrame([*rows, rows[1]], f"{ID} int, {CUSTOMER} int, {MERCHANT} int").repartition(3, ID)
    labels = spark.createDataFrame([(0, 1), (1, 1), (2, 0), (4, None)], f"{MERCHANT} int, merchant_label int")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = features.merchant_ratio(df, labels)
        plan = out._jdf.queryExecution().executedPlan().toString()
        # One before the call, one by customer.
        assert plan.count("Exchange hashpartitioning") == 2
        found = [sorted(map(str, out.collect()))]
        monkeypatch.setattr(features, "FEW_LABELS", 0)
        for hot in (None, HotKeys(hot_rows=20), HotKeys(hot_rows=0)):
            found.append(sorted(map(str, features.merchant_ratio(df, labels, hot=hot).collect())))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert all(f == found[0] for f in found) and len(found[0]) == 301


def test_merchant_rfm_needs_no_ids(spark):
    """Ids of lines are long texts; one that repeats must not tell where a gap begins either."""
    start = datetime(2024, 1, 1)
    rows = [(1 if i % 9 else None, start + timedelta(hours=h), i % 3, float(i % 7)) for i, h in enumerate([5, 1, 1, 9, 4, 4, 8, 30, 2] * 6)]
    df = spark.createDataFrame(rows, f"{ID} int, {TIME} timestamp_ntz, {MERCHANT} int, {AMOUNT} double")
    found = [
        sorted(map(str, rfm.merchant_rfm(some, hot).collect()))
        for some in (df, df.drop(ID)) for hot in (None, HotKeys(hot_rows=17), HotKeys(hot_rows=0))
    ]
    assert all(f == found[0] for f in found) and len(found[0]) == 3


def test_kmeans_starts_few_tasks(spark, monkeypatch):
    df = spark.range(200).selectExpr("cast(id % 23 as double) as p", "cast(id % 7 as double) as q").repartition(20)
    fixed, _ = clusters.fixed_points(df, ["p", "q"])
    assert fixed.rdd.getNumPartitions() == 1
    expected = clusters.kmeans(df, ["p", "q"], range(1, 5))
    monkeypatch.setattr(clusters, "ROWS_PER_TASK", 30)
    assert clusters.fixed_points(df, ["p", "q"])[0].rdd.getNumPartitions() == 7
    assert clusters.kmeans(df, ["p", "q"], range(1, 5)) == expected and len(expected[4]) == 4


def test_divisors_read_rows_once(spark):
    """What is asked of each divisor is answered by the distinct points."""
    rng = np.random.default_rng(5)
    x = [*map(tuple, np.round(rng.normal(0.5, 0.2, (150, 2)), 1).tolist()), (None, 0.9), (0.9, None), (-0.0, 0.7)]
    df = spark.createDataFrame([(*r, None) for r in x], "a double, b double, empty double")
    seen = spark.sparkContext.accumulator(0)

    def count(rows):
        for batch in rows:
            seen.add(batch.num_rows)
            yield batch

    centroid = {"a": 0.5, "b": 0.5, "empty": None}
    counted = df.mapInArrow(count, df.schema)
    sweep = noise.sweep_divisors(counted, ["a", "b"], centroid, 0.15, 20, [2]).collect()
    assert seen.value == len(x)
    po = np.array([r for r in x if None not in r and min(r) >= 0.25])
    near = np.sqrt(((po[:, None] - po[None]) ** 2).sum(axis=2)) <= 0.15
    core = near.sum(axis=1) >= max(1, len(po) - 20)
    outside = ~(near & core[None, :]).any(axis=1)
    inside = po[~outside].max(axis=0).sum() if (~outside).any() else 0.0
    assert [(r["div"], r["cal"]) for r in sweep] == [(2, pytest.approx(abs(inside - po[outside].min(axis=0).sum())))]
