"""Reading transactions and deriving the columns every feature relies on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddlot.columns import (
    AMOUNT, BASE_COLUMNS, CUSTOMER, DAY_TEXT, HOUR, ID, MERCHANT, PAIR_TEXT, RAW_TIME, TIME,
)
from oddlot.functions.scalars import day_start, hour_start, text_key

RAW_SCHEMA = T.StructType(
    [
        T.StructField(ID, T.StringType()),
        T.StructField(RAW_TIME, T.TimestampNTZType()),
        T.StructField("MerchantId", T.StringType()),
        T.StructField(CUSTOMER, T.StringType()),
        T.StructField(AMOUNT, T.DoubleType()),
    ]
)

# Times keep their microseconds in CSV; on reading the fraction is optional.
CSV_TIMES = {"timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]"}


def read_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """CSV with a header and a declared schema (no inference pass over the data)."""
    return spark.read.schema(schema).options(**CSV_TIMES).csv(path, header=True)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def prepare(raw: DataFrame, grain: str = "hour", day_column: str = "day") -> DataFrame:
    """Derive time, hour, day text and the pair label.

    ``grain='hour'`` truncates the insert time to the hour. ``grain='day'`` takes the time from
    ``day_column`` (a date or timestamp), or from the insert time's date if there is none.
    """
    if "MerchantId" in raw.columns:
        raw = raw.withColumnRenamed("MerchantId", MERCHANT)
    if grain == "hour":
        when = hour_start(F.col(RAW_TIME))
    elif grain == "day":
        when = day_start(F.col(day_column if day_column in raw.columns else RAW_TIME))
    else:
        raise ValueError(f"unknown grain {grain!r}")
    return raw.select(
        *BASE_COLUMNS,
        when.alias(TIME),
        text_key(F.col(CUSTOMER), F.col(MERCHANT)).alias(PAIR_TEXT),
        F.hour(when).alias(HOUR),
        F.to_date(when).cast("string").alias(DAY_TEXT),
    )
