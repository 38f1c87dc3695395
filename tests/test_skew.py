"""Every feature gives the same result whether keys count as hot or not."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, CUSTOMER, ID, MERCHANT, PAIR, RAW_TIME, TIME
from oddlot.operators import clean, features, quantiles, ranking, rfm, sampling, skew, stats


@pytest.fixture(scope="module")
def skewed(spark, transactions):
    """A customer and a pair with far more rows than the others, and many tied times."""
    rng = random.Random(3)
    rows = [("hot", rng.choice("xyz"), rng.randrange(400), rng.randrange(50)) for _ in range(300)]
    rows += [("hot", "x", 7, rng.randrange(50)) for _ in range(100)]
    rows += [(f"c{i % 20}", rng.choice("xyz"), rng.randrange(900), rng.randrange(90)) for i in range(300)]
    return transactions(rows).persist()


def frame(df):
    pdf = df.select(*sorted(df.columns)).toPandas()
    return pdf.sort_values(list(pdf.columns)).reset_index(drop=True)


CASES = {
    "facts": lambda df, hot: skew.with_group_facts(df, PAIR, {"n": F.count(ID), "s": F.sum(AMOUNT)}, hot),
    "previous": lambda df, hot: skew.with_previous_time(df, [CUSTOMER], TIME, ID, "p", hot),
    "trailing": lambda df, hot: skew.with_trailing_sum(df, [CUSTOMER], TIME, AMOUNT, 86_400, "s", hot),
    "noisy": lambda df, hot: clean.remove_noisy(df, hot=hot),
    "last": lambda df, hot: clean.with_last_activity(df, hot=hot),
    "norm": lambda df, hot: stats.with_min_max_norm(df, AMOUNT, PAIR, hot),
    "p_value": lambda df, hot: stats.normalised(df, AMOUNT, [CUSTOMER], "pvalue", hot).drop("Amount_t_value"),
    "aggregates": lambda df, hot: stats.group_aggregates(df, PAIR, hot=hot),
    "customer_rfm": lambda df, hot: rfm.customer_rfm(df, hot),
    "merchant_rfm": lambda df, hot: rfm.merchant_rfm(df, hot),
    "frequency": lambda df, hot: features.frequency_difference(df, hot=hot),
    "amount": lambda df, hot: features.amount_change(df, hot=hot),
    "peak": lambda df, hot: features.peak_drop(df, hot=hot),
    "month": lambda df, hot: features.last_month_totals(features.frequency_difference(df, hot=hot), hot=hot),
    "sequence": lambda df, hot: features.daily_sequence(df, hot=hot),
    "daily": lambda df, hot: features.attach_daily_counts(df, hot=hot),
    "fan_out": lambda df, hot: features.attach_daily_counts(df, "customer", hot=hot),
}


@pytest.mark.parametrize("name", CASES)
def test_hot_keys_do_not_change_results(skewed, name, monkeypatch):
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 10)
    usual = frame(CASES[name](skewed, skew.find_hot_keys(skewed)))
    split = frame(CASES[name](skewed, skew.find_hot_keys(skewed, 60)))
    assert len(usual)
    pd.testing.assert_frame_equal(usual, split, check_exact=False, rtol=1e-9)


def test_hot_keys_are_found(skewed):
    hot = skew.find_hot_keys(skewed, 250)
    assert [r[0] for r in hot.of(skewed, [CUSTOMER]).collect()] == ["hot"]
    assert hot.of(skewed, [MERCHANT, TIME]) is None
    assert skew.find_hot_keys(skewed, 10_000).small


def test_ratio_with_hot_customer(skewed, spark):
    labels = spark.createDataFrame([("x", 0), ("y", 1)], "merchant_id string, merchant_label int")
    usual = frame(features.merchant_ratio(skewed, labels))
    split = frame(features.merchant_ratio(skewed, labels, hot=skew.find_hot_keys(skewed, 60)))
    pd.testing.assert_frame_equal(usual, split)
    assert (usual[usual[MERCHANT] == "z"]["c_m_ratios"] == 0).all()
    known = usual[usual[MERCHANT] != "z"]
    assert np.allclose(known["c_m_ratios"] * known["c_m_label_t_count"], known["c_m_t_count"])


def test_previous_raw_time_of_hot_key(spark):
    rng = random.Random(5)
    rows = [(i, "k", rng.randrange(10**9)) for i in range(400)] + [(400 + i, "k", 777) for i in range(5)]
    df = spark.createDataFrame(rows, "PaymentTransactionId long, k string, us long").select(
        ID, "k", (F.timestamp_micros("us")).cast("timestamp_ntz").alias(RAW_TIME)
    )
    usual = frame(skew.with_previous_time(df, ["k"], RAW_TIME, ID, "p"))
    split = frame(skew.with_previous_time(df, ["k"], RAW_TIME, ID, "p", skew.find_hot_keys(df, 10)))
    pd.testing.assert_frame_equal(usual, split)


@pytest.mark.parametrize("values", [
    [1.0] * 500, list(range(500)), [0.0] * 400 + [1.0, 2.0, 3.0] * 30, [2.0**i for i in range(300)],
])
def test_bracketed_quantiles(spark, values, monkeypatch):
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 5)
    rng = random.Random(1)
    values = [float(v) for v in values]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.77, 0.99, 1.0]
    row = quantiles._large_quantiles(df, [], {f"q{i}": ("v", p) for i, p in enumerate(probs)}).first()
    assert list(row) == pytest.approx(np.quantile(values, probs).tolist())


def test_sample_is_the_rows_with_the_smallest_hashes(skewed):
    sample = sampling.sample_exact(skewed, 123, 9)
    ordered = skewed.orderBy(sampling.md5_rank(F.col(ID), 9), ID).limit(123)
    assert sample.count() == 123 and sample.join(ordered, ID).count() == 123
    blank = skewed.withColumn(ID, F.when(F.col(AMOUNT) > 0, F.lit(None).cast("long")).otherwise(F.col(ID)))
    assert sampling.sample_exact(blank, 123, 9).count() == 123
    assert sampling.sample_exact(skewed, 10**6).count() == 700
    assert sampling.sample_exact(skewed, 0).count() == 0


def test_row_index_over_ranges(skewed):
    ranged = ranking.with_row_index(skewed, [AMOUNT, ID], "i").orderBy("i").select(AMOUNT, ID, "i").collect()
    assert [r["i"] for r in ranged] == list(range(700))
    assert [(r[AMOUNT], r[ID]) for r in ranged] == sorted((r[AMOUNT], r[ID]) for r in ranged)


@pytest.mark.parametrize("parts", ["1", "8"])
def test_partitions_do_not_matter(spark, skewed, parts):
    usual = frame(features.frequency_difference(skewed))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        pd.testing.assert_frame_equal(usual, frame(features.frequency_difference(skewed)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
