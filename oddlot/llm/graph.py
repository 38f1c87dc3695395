"""Connected components by alternating large and small stars, wholly in distributed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.llm.store import written


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    ).first()
    return row["n"], row["h"]


def connected(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every end of ``edges(u, v)``; the component is its smallest node.

    Each round replaces the edges by those to a smaller neighbour's minimum, until nothing changes;
    the number of rounds grows with the logarithm of a component's size. Edges are 16-byte rows; minima
    are aggregated before the shuffle, so a hub with very many neighbours is split.
    """
    current = written(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    )
    before = _mark(current)
    while before[0]:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        current = written(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u != v")
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        after = _mark(current)
        if after == before:
            break
        before = after
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
