"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; a row's fractional rank is its place
in the source's own order, (rank + 1/2) / size. Sorted by fractional rank, every stretch of the corpus
holds all sources in proportion, so cutting it into equal stretches gives shards that match the mixture.
Row counts of shards differ by one at most, and a source's count in a shard is within two of its share.

Both orders are global sorts by range: rows get their place within the sorted range they fall into plus
the number of rows in earlier ranges, so a source with a third of all rows is spread over many tasks.
Only numbers are sorted, never texts. A null source is a source of its own; null texts have the size of
empty ones; rows with a null or repeated ``doc_id`` are placed like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddlot.llm.store import written

SHARDS = 24
_PLACE = (1 << 33) - 1


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """``df`` with ``name``: each row's place, from 0, in the order of the given columns."""
    rows = written(
        df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    )
    part = F.shiftright("__at", 33)
    # One row per partition of the sort.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    ranges = ranges.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (
        rows.withColumn("__part", part)
        .join(F.broadcast(ranges), "__part")
        .withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit(_PLACE)))
        .drop("__at", "__part", "__before")
    )


def interleaved_shards(docs: DataFrame, shards: int = SHARDS, seed: int = 42) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard, source, fraction`` per row of ``docs``.

    ``slot`` counts from 0 in each shard, in interleaved order.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.col("source").cast("string").alias("source"),
            (F.octet_length(text) + 8).cast("long").alias("size"),
            F.crc32(text).alias("text_crc32"),
        ).withColumn("dice", F.xxhash64("doc_id", "text_crc32", F.lit(seed)))
    )
    ranked = written(numbered(rows, "place", "source", "dice", "doc_id", "text_crc32", "size"))
    sources = ranked.groupBy(F.col("source").alias("stratum")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    fractions = (
        ranked.join(sources, F.col("source").eqNullSafe(F.col("stratum")))
        .withColumn("fraction", (F.col("place") - F.col("first") + 0.5) / F.col("n"))
        .select("doc_id", "source", "size", "text_crc32", "dice", "fraction")
    )
    ordered = numbered(written(fractions), "place", "fraction", "dice", "doc_id", "source", "text_crc32", "size")
    total = ranked.count()
    shard = F.expr(f"place * {shards} div {max(1, total)}")
    begin = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return ordered.withColumn("shard", shard).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        (F.col("place") - begin).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        "source",
        "fraction",
    )
