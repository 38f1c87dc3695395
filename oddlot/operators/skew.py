"""Grouped facts and ordered windows that survive hot keys.

Keys with few rows use ordinary windows: one exchange, no join. A key with more than
``HOT_ROWS`` rows would pull its rows into one task, so its rows are set apart and handled by
partially aggregated facts:

* group facts come from a ``groupBy`` (combined before the shuffle) and are broadcast back; there
  are at most (rows / threshold) such keys, which bounds the broadcast;
* ordered facts are computed on the distinct times of the key, never on its rows.

Hotness only chooses the plan. The result is the same for any threshold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddlot.functions.scalars import epoch_seconds
from oddlot.session import settle

HOT_ROWS = 2_000_000
SALTS = 32
ALL_HOT = "all hot"


def join_same(left: DataFrame, right: DataFrame, keys: Iterable[str], how: str = "left") -> DataFrame:
    """Join on keys where null matches null, keeping only the left side's key columns."""
    keys = list(keys)
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    joined = left.join(right, same, how)
    if how in ("left_semi", "left_anti"):
        return joined
    return joined.drop(*[f"__{k}" for k in keys])


@dataclass
class HotKeys:
    """Hot keys per key set.

    An entry is ``None`` if no group of the key set is hot, ``ALL_HOT`` if the frame holds only hot
    groups, else the table of hot keys.
    """

    hot_rows: int = HOT_ROWS
    found: dict[tuple[str, ...], DataFrame | str | None] = field(default_factory=dict)
    small: bool = False

    def of(self, df: DataFrame, keys: Iterable[str]) -> DataFrame | str | None:
        keys = tuple(keys)
        if self.small:
            return None
        if keys not in self.found:
            # A group over more columns lies inside a group over fewer of them.
            inside_small = any(t is None and set(k) <= set(keys) for k, t in self.found.items())
            self.found[keys] = None if inside_small else _find(df, keys, self.hot_rows)
        return self.found[keys]


def _find(df: DataFrame, keys: tuple[str, ...], hot_rows: int) -> DataFrame | None:
    # Every key above the threshold: at most total / hot_rows of them, so the table may be broadcast.
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > hot_rows).drop("__n")
    table = settle(counted)
    return None if table.isEmpty() else table


def find_hot_keys(df: DataFrame, hot_rows: int | None = None) -> HotKeys:
    """Start a hot-key profile of a frame; key sets are counted when first needed.

    A frame with no more rows than the threshold cannot hold a hot key, so no counting by key
    takes place for it.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    return HotKeys(limit, small=df.count() <= limit)


def hot_keys_of(sizes: DataFrame, keys: Iterable[str], hot_rows: int | None = None) -> HotKeys:
    """A profile of one key set from a written table of the sizes (``__n``) of all its groups."""
    keys = tuple(keys)
    limit = HOT_ROWS if hot_rows is None else hot_rows
    table = sizes.where(F.col("__n") > limit).select(*keys)
    return HotKeys(limit, {keys: None if table.isEmpty() else table})


def profile(df: DataFrame, hot: HotKeys | None) -> HotKeys:
    return hot if hot is not None else find_hot_keys(df)


def split(df: DataFrame, keys: Iterable[str], table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ordinary keys and rows of hot keys."""
    keys = list(keys)
    table = F.broadcast(table)
    return join_same(df, table, keys, "left_anti"), join_same(df, table, keys, "left_semi")


def in_parts(
    df: DataFrame,
    keys: Iterable[str],
    hot: HotKeys | None,
    work: Callable[[DataFrame, HotKeys], DataFrame],
) -> DataFrame:
    """Apply ``work`` to the rows of ordinary and of hot keys apart, splitting only once.

    Steps on hot rows refer to their input more than once (facts and rows), so these rows are
    written after each step instead of being recomputed by the next.
    """
    keys = tuple(keys)
    hot = profile(df, hot)
    table = hot.of(df, keys)
    if table is None or table is ALL_HOT:
        return work(df, hot)
    cold, heavy = split(df, keys, table)
    return work(cold, HotKeys(hot.hot_rows, {keys: None})).unionByName(
        work(settle(heavy), HotKeys(hot.hot_rows, {keys: ALL_HOT}))
    )


def with_group_facts(
    df: DataFrame, keys: Iterable[str], facts: dict[str, Column], hot: HotKeys | None = None
) -> DataFrame:
    """Add aggregates of each row's group as columns."""
    keys = list(keys)

    def work(part: DataFrame, weight: HotKeys) -> DataFrame:
        if weight.of(part, keys) is None:
            window = W.partitionBy(*keys)
            return part.withColumns({name: agg.over(window) for name, agg in facts.items()})
        summary = part.groupBy(*keys).agg(*[agg.alias(name) for name, agg in facts.items()])
        # One row per hot key, so at most rows / threshold.
        return settle(join_same(part, F.broadcast(summary), keys))

    return in_parts(df, keys, hot, work)


def with_previous_time(
    df: DataFrame,
    keys: Iterable[str],
    time: str,
    ident: str,
    out: str,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add the time of the previous row of the group, ordered by (time, ident)."""
    keys = list(keys)

    def work(part: DataFrame, weight: HotKeys) -> DataFrame:
        if weight.of(part, keys) is None:
            window = W.partitionBy(*keys).orderBy(time, ident)
            return part.withColumn(out, F.lag(time).over(window))
        # Rows tied on time follow a row with the same time, except the one with the smallest id.
        times = part.groupBy(*keys, time).agg(F.min(ident).alias("__first_id"))
        previous = _previous_distinct(times, keys, time).select(
            F.col("__first_id"), F.col("__before"), F.lit(True).alias("__is_first_id")
        )
        # Joined on the unique id, so a hot key spreads over all partitions.
        joined = part.join(previous, F.col(ident) == F.col("__first_id"), "left")
        prev = F.when(F.col("__is_first_id"), F.col("__before")).otherwise(F.col(time))
        return settle(
            joined.withColumn(out, prev).drop("__first_id", "__before", "__is_first_id")
        )

    return in_parts(df, keys, hot, work)


def _previous_distinct(times: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Lag over distinct times in nested buckets.

    A second holds at most 10^6 distinct microseconds, an hour 3600 seconds, and a key as many
    hours as its calendar: no window partition grows with the number of rows.
    """
    second = epoch_seconds(F.col(time))
    times = times.withColumn("__s", second).withColumn("__h", F.floor(second / 3600))
    seconds = times.groupBy(*keys, "__h", "__s").agg(F.max(time).alias("__last"))
    hours = seconds.groupBy(*keys, "__h").agg(F.max("__last").alias("__last"))
    hours = hours.select(
        *keys, "__h", F.lag("__last").over(W.partitionBy(*keys).orderBy("__h")).alias("__before_h")
    )
    seconds = seconds.select(
        *keys,
        "__h",
        "__s",
        F.lag("__last").over(W.partitionBy(*keys, "__h").orderBy("__s")).alias("__in_h"),
    )
    seconds = join_same(seconds, hours, [*keys, "__h"]).select(
        *keys, "__h", "__s", F.coalesce("__in_h", "__before_h").alias("__before_s")
    )
    inside = F.lag(time).over(W.partitionBy(*keys, "__h", "__s").orderBy(time))
    times = times.withColumn("__in_s", inside)
    return join_same(times, seconds, [*keys, "__h", "__s"]).withColumn(
        "__before", F.coalesce("__in_s", "__before_s")
    )


def with_trailing_sum(
    df: DataFrame,
    keys: Iterable[str],
    time: str,
    value: str,
    seconds: int,
    out: str,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Add the sum over the group's rows in ``(t - seconds, t]``; ``time`` has hour grain."""
    keys = list(keys)

    def trailing(part: DataFrame, column: str) -> DataFrame:
        stamp = epoch_seconds(F.col(time))
        frame = W.partitionBy(*keys).orderBy(stamp).rangeBetween(-(seconds - 1), 0)
        return part.withColumn(out, F.sum(column).over(frame))

    def work(part: DataFrame, weight: HotKeys) -> DataFrame:
        if weight.of(part, keys) is None:
            return trailing(part, value)
        hourly = part.groupBy(*keys, time).agg(F.sum(value).alias("__sum"))
        hourly = trailing(hourly, "__sum").select(*keys, time, out)
        # A hot key has far more rows than hours, so copying its hours per salt stays small, and
        # rows tied on one time spread over the salts.
        hourly = hourly.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(*part.columns), F.lit(SALTS)).cast("int")
        salted = part.withColumn("__salt", salt)
        return settle(join_same(salted, hourly, [*keys, time, "__salt"]).drop("__salt"))

    return in_parts(df, keys, hot, work)


def join_hot_aware(
    df: DataFrame, groups: DataFrame, keys: tuple[str, ...], hot: HotKeys
) -> DataFrame:
    """Left join one row per group; rows of hot keys meet a broadcast of the hot groups only."""
    table = hot.of(df, keys)
    if table is None:
        return join_same(df, groups, keys)
    if table is ALL_HOT:
        return join_same(df, F.broadcast(groups), keys)
    table = F.broadcast(table)
    hot_groups = F.broadcast(join_same(groups, table, keys, "left_semi"))
    heavy = join_same(join_same(df, table, keys, "left_semi"), hot_groups, keys)
    cold = join_same(join_same(df, table, keys, "left_anti"), groups, keys)
    return cold.unionByName(heavy)


def ranked_first(df: DataFrame, keys: Iterable[str], order: list[Column], k: int, out: str) -> DataFrame:
    """The first ``k`` rows of each group with their rank.

    The ``rank <= k`` filter makes Spark cut every group to ``k`` rows per task before the
    shuffle, so hot groups need no special care.
    """
    window = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)
