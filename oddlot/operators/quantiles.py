"""Exact quantiles (linear interpolation) of groups and of whole tables of any size.

Groups up to the hot threshold use ``percentile``. A larger group, or a whole table, would hold all its
distinct values in one task, so its order statistics are found by radix selection: each round splits what
is still in question for a rank into digits, counts them exactly, and goes on with the rows of the one digit
that holds the rank. A digit is any monotone number of a value, by turns its place between the smallest and
the largest value in question and its binary exponent, so a few rounds reach single values whatever their
spread. What lies in question for a rank is a row of a table; nothing of it passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddlot.operators.skew import HotKeys, in_parts, join_same
from oddlot.session import settle

DIGITS = 4096
#: Values in question that are sorted at once.
FINISH_ROWS = 20_000
#: Ranks in question that may be broadcast to the rows, at most 100 bytes each; more are joined over salts.
BROADCAST_ROWS = 100_000
SALTS = 32

Targets = dict[str, tuple[str, float]]


def _percentiles(targets: Targets) -> list[Column]:
    return [F.percentile(c, F.lit(p)).alias(out) for out, (c, p) in targets.items()]


def group_quantiles(
    df: DataFrame, keys: Iterable[str], targets: Targets, hot: HotKeys | None = None,
    facts: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per group with a column per ``{out: (column, probability)}`` target.

    ``facts`` are further aggregates, taken in the same pass where groups are not hot.
    """
    more = [agg.alias(name) for name, agg in (facts or {}).items()]
    keys = list(keys)

    def work(part: DataFrame, weight: HotKeys) -> DataFrame:
        if weight.of(part, keys) is None:
            return part.groupBy(*keys).agg(*_percentiles(targets), *more)
        found = _large_quantiles(part, keys, targets)
        return join_same(found, part.groupBy(*keys).agg(*more), keys, "inner") if more else found

    return in_parts(df, keys, hot, work)


def table_quantiles(df: DataFrame, targets: Targets) -> dict[str, Column]:
    """Quantiles of whole columns, as expressions that can be used on any frame."""
    one_row = settle(_large_quantiles(df, [], targets))
    return {out: one_row.select(out).scalar() for out in targets}


def _large_quantiles(df: DataFrame, keys: list[str], targets: Targets) -> DataFrame:
    """Selected quantiles, one row per group of ``keys`` (one row in all without keys)."""
    columns = sorted({c for c, _ in targets.values()})
    stacked = F.array(*[F.struct(F.lit(i).alias("__c"), F.col(c).cast("double").alias("__v")) for i, c in enumerate(columns)])
    values = df.select(*keys, F.inline(stacked)).where(F.col("__v").isNotNull())
    totals = _summary(values, keys)
    asked = F.array(*[
        F.struct(F.lit(i).alias("out"), F.lit(columns.index(c)).alias("of"), F.lit(float(p)).alias("p"))
        for i, (c, p) in enumerate(targets.values())
    ])
    place = F.col("a.p") * (F.col("__n") - 1)
    ranks = settle(
        totals.withColumn("a", F.explode(asked)).where(F.col("a.of") == F.col("__c")).select(
            *keys, "__c", "__n", "__lo", "__hi", F.col("a.out").alias("__out"),
            F.floor(place).alias("__low"), F.ceil(place).alias("__high"), (place - F.floor(place)).alias("__share"),
        )
    )
    both = [ranks.select(*keys, "__c", "__n", "__lo", "__hi", F.col(r).alias("__k")) for r in ("__low", "__high")]
    found = settle(_order_statistics(values, keys, both[0].unionByName(both[1]).distinct()))
    for rank, name in (("__low", "__a"), ("__high", "__b")):
        side = found.select(*keys, "__c", F.col("__k").alias(rank), F.col("__v").alias(name))
        ranks = join_same(ranks, side, [*keys, "__c", rank])
    value = F.when(F.col("__low") == F.col("__high"), F.col("__a")).otherwise(
        (1 - F.col("__share")) * F.col("__a") + F.col("__share") * F.col("__b")
    )
    shown = ranks.groupBy(*keys).agg(
        *[F.max(F.when(F.col("__out") == i, value)).alias(out) for i, out in enumerate(targets)]
    )
    return join_same(df.select(*keys).distinct(), shown, keys) if keys else shown


def kth_smallest(values: DataFrame, column: str, k: int, n: int) -> float:
    """The value at 0-based rank ``k`` of a column of ``n`` non-null numbers."""
    frame = values.select(F.lit(0).alias("__c"), F.col(column).cast("double").alias("__v"))
    wanted = _summary(frame, []).withColumn("__k", F.lit(k).cast("long"))
    return _order_statistics(frame, [], wanted).first()["__v"]


def _summary(values: DataFrame, keys: list[str]) -> DataFrame:
    return values.groupBy(*keys, "__c").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
    )


def _digit(by_exponent: bool) -> Column:
    """A monotone number of a value in question, different for the smallest and the largest if taken by place."""
    v, lo, hi = F.col("__v"), F.col("__lo"), F.col("__hi")
    size = F.when(F.isnan(v), 9000.0).otherwise(F.least(F.log2(F.abs(v)) + 2000, F.lit(8000.0)))
    exponent = F.when(v == 0, 0.0).when((v > 0) | F.isnan(v), F.floor(size)).otherwise(-F.floor(size)).cast("long")
    if by_exponent:
        return exponent
    # Halves, so that the width of a range does not overflow.
    width = hi / 2 - lo / 2
    place = F.floor((v / 2 - lo / 2) / F.when(width > 0, width) * DIGITS)
    even = F.least(place, F.lit(DIGITS - 1)).cast("long")
    infinite = F.isnan(width) | (width == float("inf"))
    return F.when(infinite, exponent).when(width > 0, even).otherwise((v > lo).cast("long"))


def _order_statistics(values: DataFrame, keys: list[str], wanted: DataFrame) -> DataFrame:
    """``keys, __c, __k, __v``: the values at 0-based ranks of ``wanted(keys, __c, __k, __n, __lo, __hi)``.

    ``values(keys, __c, __v)`` has no nulls; ``__n``, ``__lo`` and ``__hi`` are the group's size and extremes.
    """
    group = [*keys, "__c"]
    asked = [*group, "__k"]
    state = settle(wanted.withColumn("__rank", F.col("__k")))
    done = []

    def inside(part: DataFrame) -> DataFrame:
        """The rows in question for each rank; a hot group's rows stay where they are, or spread over salts."""
        between = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
        if part.count() <= BROADCAST_ROWS:
            return join_same(values, F.broadcast(part), group, "inner").where(between)
        salted = values.withColumn("__salt", F.pmod(F.xxhash64("__v", F.monotonically_increasing_id()), F.lit(SALTS)))
        copies = part.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        return join_same(salted, copies, [*group, "__salt"], "inner").drop("__salt").where(between)

    by_exponent = False
    while True:
        closed = F.col("__lo").eqNullSafe(F.col("__hi"))
        done.append(state.where(closed).select(*asked, F.col("__lo").alias("__v")))
        state = state.where(~closed)
        small = settle(state.where(F.col("__n") <= FINISH_ROWS))
        if not small.isEmpty():
            # Few rows per rank.
            listed = inside(small).groupBy(*asked, "__rank").agg(F.sort_array(F.collect_list("__v")).alias("__all"))
            done.append(listed.select(*asked, F.element_at("__all", (F.col("__rank") + 1).cast("int")).alias("__v")))
        state = settle(state.where(F.col("__n") > FINISH_ROWS))
        if state.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), done)
        counted = inside(state).withColumn("__d", _digit(by_exponent)).groupBy(*asked, "__rank", "__d").agg(
            F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")
        )
        # At most DIGITS rows per rank, or as many as there are exponents.
        before = F.sum("__n").over(W.partitionBy(*asked).orderBy("__d")) - F.col("__n")
        here = reduce(and_, [F.col("__rank") >= F.col("__before"), F.col("__rank") < F.col("__before") + F.col("__n")])
        state = settle(
            counted.withColumn("__before", before).where(here)
            .withColumn("__rank", F.col("__rank") - F.col("__before")).drop("__before", "__d")
        )
        by_exponent = not by_exponent
