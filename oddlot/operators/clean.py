"""Noise removal, activity flags and train/test splits."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.columns import CUSTOMER, ID, PAIR, TIME
from oddlot.operators.pair_state import FREQUENCY, attach_pairs, enough
from oddlot.operators.skew import HotKeys, join_hot_aware, profile, with_group_facts
from oddlot.session import settle

MIN_TRANSACTIONS = 5
TRAIN_END = datetime(2019, 11, 1)


def remove_noisy(
    df: DataFrame,
    min_transactions: int | None = MIN_TRANSACTIONS,
    min_days: int | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Keep pairs with enough transactions, or everything if no pair has enough.

    Adds ``frequency``, the number of transactions of the pair. ``min_days`` additionally asks
    for that many distinct days of activity of the customer.
    """
    df = df.drop(FREQUENCY)
    hot = profile(df, hot)
    # One row per pair, combined before the shuffle; written once because the rule reads it again.
    sizes = df.groupBy(*PAIR).agg(F.count(ID).alias(FREQUENCY))
    if min_transactions:
        sizes = settle(sizes)
        sizes = sizes.where(enough(sizes, min_transactions))
    counted = attach_pairs(df, sizes, [FREQUENCY], hot, drop=True)
    if min_days:
        days = df.select(CUSTOMER, F.to_date(TIME).alias("d")).distinct().groupBy(CUSTOMER).count()
        counted = keep_members(counted, days.where(F.col("count") >= min_days), CUSTOMER, hot)
    return counted


def with_last_activity(df: DataFrame, grain: str = "hour", hot: HotKeys | None = None) -> DataFrame:
    """``day_max`` and ``is_last_day``: whether the row falls in the customer's last hour or day."""
    out = with_group_facts(df.drop("day_max", "is_last_day"), [CUSTOMER], {"day_max": F.max(TIME)}, hot)
    if grain == "hour":
        same = F.col(TIME) == F.col("day_max")
    elif grain == "day":
        same = F.to_date(TIME) == F.to_date("day_max")
    else:
        raise ValueError(f"unknown grain {grain!r}")
    return out.withColumn("is_last_day", same.cast("int"))


def split_by_date(df: DataFrame, end: datetime | str = TRAIN_END) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(str(end)).cast("timestamp_ntz")
    return df.where(F.col(TIME) < cut), df.where(F.col(TIME) >= cut)


def split_by_last_activity(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("is_last_day") == 0), df.where(F.col("is_last_day") == 1)


def _with_membership(df: DataFrame, members: DataFrame, key: str, hot: HotKeys | None) -> DataFrame:
    known = members.select(key).distinct().withColumn("__member", F.lit(True))
    return join_hot_aware(df, known, (key,), profile(df, hot))


def keep_members(df: DataFrame, members: DataFrame, key: str, hot: HotKeys | None = None) -> DataFrame:
    """Rows whose key occurs in ``members``."""
    return _with_membership(df, members, key, hot).where(F.col("__member").isNotNull()).drop("__member")


def drop_members(df: DataFrame, members: DataFrame, key: str, hot: HotKeys | None = None) -> DataFrame:
    return _with_membership(df, members, key, hot).where(F.col("__member").isNull()).drop("__member")


def replaced_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop columns that are about to be computed again."""
    return df.drop(*[n for n in names if n in df.columns])
