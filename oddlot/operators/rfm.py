"""Recency, frequency and monetary value of merchants and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, CUSTOMER, ID, MERCHANT, TIME
from oddlot.functions.scalars import SECONDS_PER_DAY, epoch_seconds, hours_between
from oddlot.operators.quantiles import group_quantiles
from oddlot.operators.skew import HotKeys, hot_keys_of, profile, with_previous_time
from oddlot.session import settle

RFM = ("recency", "frequency", "monetary")


def hours_until_reference(df: DataFrame, since: Column) -> Column:
    """Hours from a time to one day after the last transaction."""
    now = df.agg((epoch_seconds(F.max(TIME)) + SECONDS_PER_DAY).alias("t")).scalar()
    return (now - epoch_seconds(since)) / F.lit(3600.0)


def customer_rfm(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Per customer: hours since the last activity, mean gap in hours, median amount.

    The mean of consecutive gaps telescopes to (last - first) / (n - 1), so no ordering is needed.
    Customers with one transaction have no gap and are left out.
    """
    facts = {"__first": F.min(TIME), "__last": F.max(TIME), "__n": F.count(TIME)}
    found = group_quantiles(df, [CUSTOMER], {"monetary": (AMOUNT, 0.5)}, profile(df, hot), facts)
    return found.where((F.col("__n") > 1) & F.col("monetary").isNotNull()).select(
        CUSTOMER,
        hours_until_reference(df, F.col("__last")).alias("recency"),
        (hours_between(F.col("__last"), F.col("__first")) / (F.col("__n") - 1)).alias("frequency"),
        "monetary",
    )


def merchant_rfm(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """Per merchant: hours since the last activity, median gap in hours, median amount.

    The rows are worked out twice, once for what is needed of all of them and once for the gaps. Rows
    of one time have the same gaps in any order, so a number that only tells rows apart stands in for the id.
    """
    ends = df
    if hot is None:
        # One row per merchant.
        ends = settle(df.groupBy(MERCHANT).agg(F.count(F.lit(1)).alias("__n"), F.max(TIME).alias(TIME)))
        hot = hot_keys_of(ends, [MERCHANT])
    rows = df.select(MERCHANT, TIME, F.monotonically_increasing_id().alias(ID), AMOUNT)
    gaps = with_previous_time(rows, [MERCHANT], TIME, ID, "__prev", hot).withColumn(
        "__gap", hours_between(F.col(TIME), F.col("__prev"))
    )
    targets = {"frequency": ("__gap", 0.5), "monetary": (AMOUNT, 0.5)}
    found = group_quantiles(gaps, [MERCHANT], targets, hot, {"__last": F.max(TIME)})
    return found.where(F.col("frequency").isNotNull() & F.col("monetary").isNotNull()).select(
        MERCHANT, hours_until_reference(ends, F.col("__last")).alias("recency"), "frequency", "monetary"
    )
