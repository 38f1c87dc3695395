"""Row-level expressions. Everything here stays a native column expression."""

from __future__ import annotations

from functools import reduce
from operator import add, and_

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400


def hour_start(ts: Column) -> Column:
    """Truncate a ``timestamp_ntz`` to the hour without passing through the session zone."""
    return F.make_timestamp_ntz(
        F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts), F.lit(0), F.lit(0)
    )


def day_start(ts: Column) -> Column:
    return F.to_date(ts).cast("timestamp_ntz")


def epoch_seconds(ts: Column) -> Column:
    """Whole seconds since 1970 from the fields of a ``timestamp_ntz``; no session zone involved."""
    day = F.unix_date(F.to_date(ts)).cast("long") * SECONDS_PER_DAY
    return day + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def hours_between(later: Column, earlier: Column) -> Column:
    """Fractional hours as DOUBLE."""
    return (epoch_seconds(later) - epoch_seconds(earlier)) / F.lit(3600.0)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Min-max scale; a zero range gives 0 and a null value stays null."""
    span = high - low
    return F.when(span != 0, (value - low) / span).when(value.isNotNull(), F.lit(0.0))


def day_part(hour: Column) -> Column:
    return (
        F.when(hour < 8, F.lit("[0-8)"))
        .when(hour < 12, F.lit("[8-12)"))
        .when(hour < 18, F.lit("[12-18)"))
        .otherwise(F.lit("[18-24)"))
    )


def around_mean(p: Column, mean: Column) -> Column:
    """Distance of a probability from a mean, as a share of that mean."""
    return F.when(mean != 0, F.abs(p - mean) / mean).otherwise(p)


def row_total(names: list[str]) -> Column:
    """Row-wise sum of columns; null as soon as one of them is null."""
    return reduce(add, [F.col(n) for n in names])


def at_least(centroid: dict[str, float | Column | None], divisor: float = 1) -> Column:
    """Every feature at or above its centroid value over ``divisor``; null centroids are ignored."""
    tests = [
        F.col(name) >= (c if isinstance(c, Column) else F.lit(float(c))) / F.lit(float(divisor))
        for name, c in centroid.items()
        if c is not None
    ]
    return reduce(and_, tests, F.lit(True))


def cut_flag(value: Column, cut: Column) -> Column:
    """-1 at or above the cut, else 0."""
    return F.when(value >= cut, F.lit(-1)).otherwise(F.lit(0))


def text_key(*parts: Column) -> Column:
    return F.concat_ws("_", *[p.cast("string") for p in parts])


def md5_rank(ident: Column, seed: int) -> Column:
    """32 hex digits that order rows the same way on every engine and partitioning."""
    return F.md5(F.concat(ident.cast("string"), F.lit(f"|{seed}")))


def md5_unit(ident: Column, seed: int) -> Column:
    """Uniform number in [0, 1) from the first 13 hex digits (52 bits, exact in a double)."""
    digits = F.substring(md5_rank(ident, seed), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(2**52))
