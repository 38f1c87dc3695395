"""Canonical transaction views over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, CUSTOMER, ID, MERCHANT, RAW_TIME


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """``events``: the user is the customer, the event type the merchant."""
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias(ID),
        F.col("ts").alias(RAW_TIME),
        F.col("event_type").alias(MERCHANT),
        F.col("user_id").alias(CUSTOMER),
        F.col("value").alias(AMOUNT),
    )


def lineitem_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """``lineitem`` joined to ``orders``: the order's customer buys from the line's supplier."""
    lines = read_table(spark, folder, "lineitem")
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    ident = F.concat_ws(
        "-",
        F.col("l_orderkey").cast("string"),
        F.col("l_linenumber").cast("string"),
        F.col("l_partkey").cast("string"),
        F.col("l_suppkey").cast("string"),
        F.date_format("l_shipdate", "yyyyMMdd"),
        F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string"),
    )
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        ident.alias(ID),
        F.col("l_shipdate").alias(RAW_TIME),
        F.col("l_suppkey").alias(MERCHANT),
        F.col("o_custkey").alias(CUSTOMER),
        F.col("l_extendedprice").alias(AMOUNT),
    )
