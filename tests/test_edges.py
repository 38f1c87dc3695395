"""Empty tables and null keys."""

import pytest
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, CUSTOMER, ID, MERCHANT
from oddlot.operators import clean, clusters, explore, features, noise, quantiles, rfm, sampling, skew, stats
from oddlot.plans.registry import lines
from oddlot.sources import segments
from tests.conftest import SMALL


@pytest.fixture(scope="module")
def empty(small_events):
    return small_events.limit(0)


@pytest.mark.parametrize("work", [
    features.frequency_difference, features.amount_change, features.peak_drop, features.slope,
    features.daily_sequence, features.customer_encoder, clean.remove_noisy, clusters.cluster_merchants,
    clusters.customer_mixture_scores, lambda df: sampling.sample_exact(df, 5),
    lambda df: stats.with_iqr_outlier(df, [AMOUNT]), lambda df: stats.h0_labels(df, [AMOUNT]),
    lambda df: noise.predict(df, [AMOUNT], {"eps": 0.1, "centroids": {AMOUNT: None}}),
])
def test_empty_tables_stay_empty(empty, work):
    assert work(empty).count() == 0


def test_rows_with_null_keys_are_kept(spark, small_events):
    df = small_events.withColumn(CUSTOMER, F.when(F.col(ID) % 2 == 0, F.col(CUSTOMER)))
    n = df.count()
    hot = skew.find_hot_keys(df, 50)
    out = skew.with_group_facts(df, [CUSTOMER], {"n": F.count(ID)}, hot)
    assert out.count() == n
    assert out.where(F.col(CUSTOMER).isNull()).select("n").distinct().count() == 1


def test_null_values_do_not_count_in_quantiles(spark):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double")
    cut = quantiles.table_quantiles(df, {"q": ("v", 0.5)})["q"]
    assert df.select(cut.alias("q")).first()["q"] == 2.0


def test_members(small_events):
    some = small_events.where(F.col(CUSTOMER) < 5)
    kept = clean.keep_members(small_events, some, CUSTOMER)
    assert kept.count() + clean.drop_members(small_events, some, CUSTOMER).count() == small_events.count()
    assert kept.where(F.col(CUSTOMER) >= 5).count() == 0


def test_top_entities_are_ordered(small_events):
    rows = explore.top_entities(small_events, CUSTOMER, AMOUNT, 3).collect()
    values = [r[AMOUNT] for r in rows]
    assert len(rows) == 3 and values == sorted(values, reverse=True)


def test_groups_with_a_null_key_are_not_lost(small_events):
    df = small_events.withColumn(CUSTOMER, F.when(F.col(ID) % 2 == 0, F.col(CUSTOMER)))
    keys = df.select(CUSTOMER).distinct().count()
    assert stats.group_aggregates(df, [CUSTOMER]).count() == keys
    assert rfm.customer_rfm(df).where(F.col(CUSTOMER).isNull()).count() == 1
    blank = small_events.withColumn(MERCHANT, F.when(F.col(MERCHANT) != "view", F.col(MERCHANT)))
    assert rfm.merchant_rfm(blank).where(F.col(MERCHANT).isNull()).count() == 1
    assert features.daily_sequence(df).where(F.col(CUSTOMER).isNull()).count() > 0


def test_rows_without_a_new_merchant_are_spread(spark):
    df = lines(spark, SMALL)
    parts = segments.merchant_segments(df)
    before = {c: spark.conf.get(c) for c in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = segments.inject_anomalies(df, parts)
        sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*")).select("count(1)").collect()]
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert sum(sizes) == df.count() and max(sizes) < 2.5 * sum(sizes) / 4
