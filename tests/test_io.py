"""Sources, sinks, parameters and name resolution."""

import pytest
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, ID, TIME
from oddlot.operators import explore
from oddlot.plans import feature_run, score_run
from oddlot.sources import scan, sinks
from oddlot.sources.views import event_transactions
from tests.conftest import SMALL


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_round_trip(spark, tmp_path, fmt):
    raw = event_transactions(spark, SMALL).select(
        F.col(ID).cast("string"), "RequestInsertTime", F.col("merchant_id").alias("MerchantId"),
        F.col("customer_id").cast("string"), AMOUNT,
    )
    path = str(tmp_path / fmt)
    sinks.write_table(raw, path, fmt)
    read = scan.read_csv(spark, path) if fmt == "csv" else scan.read_parquet(spark, path)
    assert sorted(map(tuple, read.collect())) == sorted(map(tuple, raw.collect()))
    prepared = scan.prepare(read)
    assert prepared.where(F.minute(TIME) != 0).count() == 0
    with pytest.raises(ValueError):
        sinks.write_table(raw, path, "xml")


def test_day_column_is_used(spark):
    raw = event_transactions(spark, SMALL).limit(3)
    out = scan.prepare(raw.withColumn("day", F.lit("2020-02-29 10:00:00").cast("timestamp_ntz")), "day")
    assert [r["Created_Time_str"] for r in out.collect()] == ["2020-02-29"] * 3
    with pytest.raises(ValueError):
        scan.prepare(raw, "week")


def test_parameters(spark, tmp_path):
    params = {"eps": 0.1, "min_samples": 5, "centroids": {"a": 0.5, "b": 0.25}, "optimum_divison": 2}
    sinks.write_params(spark, str(tmp_path / "p"), params)
    assert sinks.read_params(spark, str(tmp_path / "p")) == params
    assert sinks.read_params(spark, str(tmp_path / "missing")) is None


def test_feature_names():
    assert feature_run.resolve("all") == list(feature_run.DEFAULT_FEATURES)
    assert feature_run.resolve("slope-c_freq_diff") == ["c_freq_diff", "slope"]
    assert feature_run.resolve(["c_freq_diff_min_max_p_value"]) == ["c_freq_diff"]
    assert feature_run.score_columns(["c_freq_diff", "slope"], "pvalue") == ["c_freq_diff_p_value", "slope"]
    with pytest.raises(KeyError):
        feature_run.resolve("nothing")
    with pytest.raises(KeyError):
        score_run.resolve("nothing")


def test_rerun_replaces_features(small_events):
    once = feature_run.run_features(small_events, ["c_freq_diff", "slope"])
    assert sorted(feature_run.run_features(once, ["slope"]).columns) == sorted(once.columns)


def test_scatter_filters(small_events):
    out = explore.scatter(small_events, "hour", AMOUNT, "hour", "Created_Time_str", customer=5)
    assert out.columns == [ID, "hour", AMOUNT, "Created_Time_str"]
    assert out.count() == small_events.where("customer_id = 5").count()
    assert explore.scatter(small_events, "hour", AMOUNT, "hour", "Created_Time_str").count() == small_events.count()
