"""Dense row numbers over a whole table without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from oddlot.session import settle


def with_row_index(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """Add 0-based positions in the given order, which must be total.

    Rows are range partitioned and sorted; the position is the offset of the partition plus the
    position within it. The sorted rows are written once, because the offsets and the rows must
    come from the same ranges. There are as many ranges as the session has shuffle partitions, and
    offsets are one row per range.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settle(placed.withColumn("__at", F.monotonically_increasing_id()))
    # monotonically_increasing_id: partition number above the 33 bits of the position.
    placed = placed.withColumn("__range", F.shiftright("__at", 33)).withColumn(
        "__pos", F.col("__at").bitwiseAND(F.lit(2**33 - 1))
    )
    sizes = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__size"))
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset")
    )
    return (
        placed.join(F.broadcast(offsets), "__range")
        .withColumn(out, F.col("__offset") + F.col("__pos"))
        .drop("__at", "__range", "__pos", "__offset")
    )
