"""Bit sets of fixed size, built by Spark, that let a scan skip most rows nobody asks for.

A set has ``BITS`` bits whatever the number of values, so its broadcast is bounded. It never misses a
listed value; a full one merely lets everything through, and what follows joins exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 24


def slot(value: Column) -> Column:
    """The bit of a value; null for null."""
    return F.when(value.isNotNull(), F.xxhash64(value).bitwiseAND(F.lit(BITS - 1)))


def build(df: DataFrame, place: Column) -> Broadcast:
    """The bits at ``place``, a column of numbers from 0 below ``BITS``: at most 512 rows of 4 KB."""
    place = place + 1
    rows = (
        df.groupBy(F.bitmap_bucket_number(place).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
        .filter("bucket > 0")
        .collect()
    )
    out = np.zeros(BITS // 8, dtype=np.uint8)
    for row in rows:
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(bytes(row["bits"]), dtype=np.uint8)
    return df.sparkSession.sparkContext.broadcast(out)


def listed(bits: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Which of the places are set."""
    place = place.astype(np.int64)
    return (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def only(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, ...)`` whose id may occur in ``ids(doc_id)``; null ids do not.

    A scan drops most other rows this way before anything of them is shuffled.
    """
    bits = build(ids, slot(F.col("doc_id")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            where = batch.schema.get_field_index("__slot")
            places = batch.column(where).to_numpy(zero_copy_only=False)
            kept = batch.filter(pa.array(listed(bits.value, places)))
            yield kept.drop_columns(["__slot"])

    rows = docs.filter("doc_id is not null").withColumn("__slot", slot(F.col("doc_id")))
    return rows.mapInArrow(run, docs.schema)
