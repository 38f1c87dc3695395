"""Cases worked out by hand."""

import pytest
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, ID
from oddlot.functions.student import two_sided_mass
from oddlot.operators import clean, features, noise, skew, stats
from oddlot.operators.clusters import knee

PAIRS = {"a": [10, 12, 11, 100, 9], "b": [5, 5, 7, 8, 20], "c": [1, 2, 3, 4, 6]}


def by_id(df, column):
    return [r[column] for r in df.orderBy(ID).select(column).collect()]


def test_peak_and_drop(transactions):
    df = transactions([(k, "m", i, a) for k, v in PAIRS.items() for i, a in enumerate(v)])
    out = features.peak_drop(df)
    assert by_id(out, features.PEAK_SCORE) == pytest.approx([1] * 5 + [10 / 86] * 5 + [0] * 5)
    assert set(by_id(out, "drop_score")) == {0.0}
    extreme = by_id(features.peak_drop(df, attach="extreme"), features.PEAK_SCORE)
    assert extreme == pytest.approx([0, 0, 0, 1, 0, 0, 0, 0, 0, 10 / 86, 0, 0, 0, 0, 0])


def test_frequency_difference(transactions):
    df = transactions([("a", "m", 0, 1), ("a", "m", 1, 1), ("a", "m", 49, 1)])
    out = features.frequency_difference(df)
    assert by_id(out, "customer_freq") == pytest.approx([73 / 3] * 2)
    assert by_id(out, "day_diff") == [1, 48]
    assert by_id(out, "c_freq_diff") == pytest.approx([73 / 3 - 1, 73 / 3])
    assert by_id(out, "c_freq_diff_min_max_p_value") == [0, 1]
    zero = features.frequency_difference(df, positive="zero")
    assert by_id(zero, "c_freq_diff_min_max_p_value") == [1, 0]


def test_slope(transactions):
    rows = [("a", "m", i, x) for i, x in enumerate([100, 12, 11, 10, 9])]
    # A flat pair gives the scale its zero, a pair of one has no slope.
    rows += [("b", "m", i, 7) for i in range(4)] + [("c", "m", 0, 50)]
    out = by_id(features.slope(transactions(rows)), "slope")
    assert out == [1.0, 0, 0, 0, 1.0, 0, 0, 0, 0, 0]


def test_rolling_thirty_days(transactions):
    df = transactions([("a", "m", 24 * d, x) for d, x in ((0, 10), (29, 20), (30, 30))])
    out = skew.with_trailing_sum(df, ["customer_id"], "Created_Time", AMOUNT, 30 * 86_400, "s")
    assert by_id(out, "s") == [10, 30, 50]


def test_elbow(spark):
    distances = [10.0, 6.0, 4.0, 3.0, 2.5, 2.2, 2.0, 1.9, 1.85]
    sweep = spark.createDataFrame(list(enumerate(distances, 1)), "k int, distance double")
    assert knee(sweep, "k", "distance").first()["k"] == 4
    flat = spark.createDataFrame([(1, 1.0), (2, 1.0)], "k int, distance double")
    assert knee(flat, "k", "distance").first()["k"] is None


def test_iqr(spark):
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate([*range(1, 9), 100])], "customer_id int, v double")
    inliers, outliers = stats.iqr_split(df, ["v"])
    assert [r["v"] for r in outliers.collect()] == [100.0]
    assert inliers.count() == 8


@pytest.mark.parametrize("min_samples, noisy", [(2, {5.0}), (3, {5.0}), (4, {0, 0.1, 0.2, 5})])
def test_noise(spark, min_samples, noisy):
    df = spark.createDataFrame([(x,) for x in (0.0, 0.1, 0.2, 5.0)], "x double")
    out = noise.with_noise(df, ["x"], 0.15, min_samples)
    assert {r["x"] for r in out.where("noise").collect()} == noisy


def test_t_scores(transactions):
    df = transactions([("a", "m", i, x) for i, x in enumerate([1, 2, 4])])
    out = stats.normalised(df, AMOUNT, ["customer_id"], "pvalue")
    assert by_id(out, "Amount_t_value") == pytest.approx([1.06904, 0.26726, 1.33631], abs=1e-5)
    assert by_id(out, "Amount_p_value") == pytest.approx([0.603023, 0.185695, 0.686803], abs=1e-6)


def test_t_table_values(spark):
    # Two-sided 90 % points; the last two rows use the quadrature.
    table = [
        (6.3138, 1), (2.9200, 2), (2.3534, 3), (2.1318, 4), (2.0150, 5), (1.8595, 8),
        (1.6525, 200), (1.65247, 201), (1.64485, 10**9),
    ]
    df = spark.createDataFrame(table, "t double, nu long")
    out = df.select(two_sided_mass(F.col("t"), F.col("nu")).alias("p")).collect()
    assert [r["p"] for r in out] == pytest.approx([0.9] * len(table), abs=2e-5)


def test_t_methods_agree_at_the_seam(spark):
    from oddlot.functions import student

    df = spark.createDataFrame([(x / 4, 200) for x in range(20)], "t double, nu long")
    t, nu = F.col("t"), F.col("nu")
    rows = df.select(student._finite_sum(t, nu).alias("a"), student._quadrature(t, nu).alias("b")).collect()
    assert [r["a"] for r in rows] == pytest.approx([r["b"] for r in rows], abs=1e-11)


def test_constant_groups_have_no_t_score(transactions):
    out = stats.normalised(transactions([("a", "m", 0, 3), ("a", "m", 1, 3)]), AMOUNT, ["customer_id"], "pvalue")
    assert by_id(out, "Amount_p_value") == [None, None]


def test_noisy_pairs(transactions):
    five, two = [("a", "m", i, 1) for i in range(5)], [("b", "m", i, 1) for i in range(2)]
    assert {r["customer_id"] for r in clean.remove_noisy(transactions(five + two)).collect()} == {"a"}
    other = [("c", "m", i, 1) for i in range(2)]
    assert clean.remove_noisy(transactions(two + other)).count() == 4
    assert clean.remove_noisy(transactions(five + two), None).count() == 7
    assert clean.remove_noisy(transactions(five + two), 5, min_days=2).count() == 0


def test_min_max(transactions):
    df = transactions([("x", "m", 0, 3), ("x", "m", 1, 3), ("y", "m", 0, 1), ("y", "m", 1, 5)])
    assert by_id(stats.with_min_max_norm(df, AMOUNT, ["customer_id"]), "Amount_min_max_p_value") == [0, 0, 0, 1]


def test_min_sample_grid():
    assert noise.min_sample_grid(100) == [1, 3, 5, 9, 13, 17, 20, 24, 28]


def test_daily_sequence_is_exclusive_of_the_last_hour(transactions):
    df = transactions([("a", "m", 5, 2), ("a", "m", 5, 4), ("a", "m", 29, 8), ("b", "m", 3, 1)])
    out = features.daily_sequence(df).orderBy("Created_Time").collect()
    assert [(r["customer_id"], r[AMOUNT], r["hour_count"], r["hour"], r["total_days"]) for r in out] == [("a", 3.0, 2, 5, 1)]
