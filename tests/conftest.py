import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "America/New_York")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def transactions(spark):
    """Build a prepared frame from (customer, merchant, hour, amount) rows, ids in row order."""
    from oddlot.sources.scan import prepare

    def build(rows):
        data = [
            (i, START + timedelta(hours=h), m, c, float(a)) for i, (c, m, h, a) in enumerate(rows)
        ]
        schema = (
            "PaymentTransactionId long, RequestInsertTime timestamp_ntz, merchant_id string, "
            "customer_id string, Amount double"
        )
        return prepare(spark.createDataFrame(data, schema))

    return build


@pytest.fixture(scope="session")
def small_events(spark):
    from oddlot.plans.registry import events

    return events(spark, SMALL).persist()
