"""Descriptive statistics, normalisation, probability scores and outlier fences."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import add, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, CUSTOMER, ID
from oddlot.functions.scalars import around_mean, min_max
from oddlot.functions.student import t_statistic, two_sided_mass
from oddlot.operators.quantiles import group_quantiles, table_quantiles
from oddlot.operators.skew import HotKeys, join_same, profile, with_group_facts

MIN_MAX_SUFFIX = "_min_max_p_value"
P_VALUE_SUFFIX = "_p_value"


def group_aggregates(
    df: DataFrame, keys: Iterable[str], value: str = AMOUNT, ident: str = ID,
    hot: HotKeys | None = None,
) -> DataFrame:
    """min, max, mean, median, sum, sample std, count and the first id by value."""
    keys = list(keys)
    facts = {
        "min": F.min(value),
        "max": F.max(value),
        "mean": F.avg(value),
        "sum": F.sum(value),
        "std": F.stddev_samp(value),
        "count": F.count(value),
        "first_id": F.min_by(ident, F.struct(F.col(value), F.col(ident))),
    }
    found = group_quantiles(df, keys, {"median": (value, 0.5)}, profile(df, hot), facts)
    return found.select(*keys, *facts, "median")


def grouped_stats(df: DataFrame, value: str, keys: Iterable[str]) -> DataFrame:
    """Mean, sample standard deviation and non-null count per group."""
    return df.groupBy(*keys).agg(
        F.avg(value).alias(f"{value}_mean"),
        F.stddev_samp(value).alias(f"{value}_std"),
        F.count(value).alias(f"{value}_count"),
    )


def with_grouped_stats(
    df: DataFrame, value: str, keys: Iterable[str], hot: HotKeys | None = None
) -> DataFrame:
    facts = {
        f"{value}_mean": F.avg(value),
        f"{value}_std": F.stddev_samp(value),
        f"{value}_count": F.count(value),
    }
    return with_group_facts(df.drop(*facts), keys, facts, hot)


def with_table_stats(df: DataFrame, *values: str) -> DataFrame:
    """Mean, population standard deviation and row count of the table on every row, per column.

    One aggregate serves all columns.
    """
    facts = [F.struct(F.avg(v).alias("mean"), F.stddev_pop(v).alias("std")).alias(f"of_{i}") for i, v in enumerate(values)]
    one_row = df.agg(F.struct(*facts, F.count(F.lit(1)).alias("count")).alias("facts")).scalar()
    added = {}
    for i, v in enumerate(values):
        added |= {f"{v}_{name}": one_row[f"of_{i}"][name] for name in ("mean", "std")}
        added[f"{v}_count"] = one_row["count"]
    return df.withColumns(added)


def with_table_min_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """Min-max score over the whole table."""
    ends = df.agg(F.struct(F.min(value).alias("low"), F.max(value).alias("high")).alias("ends")).scalar()
    return df.withColumn(out, min_max(F.col(value), ends["low"], ends["high"]))


def with_min_max_norm(
    df: DataFrame, value: str, keys: Iterable[str], hot: HotKeys | None = None
) -> DataFrame:
    """``<value>_min_max_p_value``: min-max score within the group."""
    out = df.drop(value + MIN_MAX_SUFFIX)
    out = with_group_facts(out, keys, {"__low": F.min(value), "__high": F.max(value)}, hot)
    score = min_max(F.col(value), F.col("__low"), F.col("__high"))
    return out.withColumn(value + MIN_MAX_SUFFIX, score).drop("__low", "__high")


def with_p_value(df: DataFrame, value: str) -> DataFrame:
    """``<value>_t_value`` and ``<value>_p_value`` from the statistics already on the row.

    The CDF of a non-negative statistic is ``0.5 + A/2``; its distance around 0.5 is ``A``.
    """
    t = t_statistic(
        F.col(value), F.col(f"{value}_mean"), F.col(f"{value}_std"), F.col(f"{value}_count")
    )
    df = df.withColumn(f"{value}_t_value", t)
    mass = two_sided_mass(F.col(f"{value}_t_value"), F.col(f"{value}_count") - 1)
    cdf = F.lit(0.5) + mass / 2
    return df.withColumn(value + P_VALUE_SUFFIX, around_mean(cdf, F.lit(0.5)))


def normalised(
    df: DataFrame, value: str, keys: Iterable[str], method: str = "minmax", hot: HotKeys | None = None
) -> DataFrame:
    """Add the group's min-max score or its p-value score."""
    if method == "minmax":
        return with_min_max_norm(df, value, keys, hot)
    if method == "pvalue":
        return with_p_value(with_grouped_stats(df, value, keys, hot), value)
    raise ValueError(f"unknown normalisation {method!r}")


def normalised_name(value: str, method: str = "minmax") -> str:
    return value + (MIN_MAX_SUFFIX if method == "minmax" else P_VALUE_SUFFIX)


def h0_labels(df: DataFrame, features: list[str], alpha: float = 0.05) -> DataFrame:
    """Per feature, the table-wide p-score and whether it rejects the null hypothesis."""
    df = with_table_stats(df, *features)
    for f in features:
        df = with_p_value(df, f)
        score = F.coalesce(F.col(f + P_VALUE_SUFFIX), F.lit(0.0))
        df = df.withColumn(f + P_VALUE_SUFFIX, score).withColumn(
            f"{f}_h0_rejected", F.when(score > alpha, 1).otherwise(0)
        )
        df = df.drop(*[f"{f}_{x}" for x in ("mean", "std", "count", "t_value")])
    return df


def h0_target(df: DataFrame, features: list[str], out: str = "target") -> DataFrame:
    """1 where every feature rejects the null hypothesis."""
    votes = reduce(add, [F.col(f"{f}_h0_rejected") for f in features])
    return df.withColumn(out, F.when(votes == len(features), 1).otherwise(0))


def with_iqr_outlier(
    df: DataFrame, columns: list[str], out: str = "is_outlier", width: float = 3.0
) -> DataFrame:
    """Mark rows outside ``width`` interquartile ranges in any of the columns."""
    targets = {}
    for c in columns:
        targets[f"{c}_q1"], targets[f"{c}_q3"] = (c, 0.25), (c, 0.75)
    q = table_quantiles(df, targets)
    tests = []
    for c in columns:
        span = q[f"{c}_q3"] - q[f"{c}_q1"]
        low, high = q[f"{c}_q1"] - width * span, q[f"{c}_q3"] + width * span
        tests.append((F.col(c) < low) | (F.col(c) > high))
    return df.withColumn(out, F.coalesce(reduce(or_, tests), F.lit(False)))


def iqr_split(df: DataFrame, columns: list[str], entity: str = CUSTOMER) -> tuple[DataFrame, DataFrame]:
    """Inliers and outliers; an entity outlying in one of its rows goes to the outliers."""
    marked = with_iqr_outlier(df, columns, "__out")
    outlying = marked.where("__out").select(entity).distinct()
    return join_same(df, outlying, [entity], "left_anti"), join_same(df, outlying, [entity], "left_semi")


