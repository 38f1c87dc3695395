"""Benchmark decontamination: MinHash containment search, partitioned by size.

An item is contained in a document when at least ``percent``/100 of its distinct ``k``-word shingles
occur there. A short item in a long document has a tiny Jaccard similarity, so both sides are brought to
comparable sizes first. Documents keep, in order, only shingles that may occur in some item (by a bit set of
fixed size, whatever the benchmark's size), which leaves a passage standing close together however long the
document is. Items fall into classes by the power of two of their shingle count, and for each class that occurs
what is left of a document is covered by overlapping windows of two blocks, a block being as long as the class's
largest item. Windows and items are sketched by ``FUNCTIONS`` minima, and one equal minimum makes a candidate.

Candidates are verified by exact containment over all rows of the document. A passage whose window holds
nothing else has a similarity of 0.8 or more and is missed with a chance below 1e-22; where other items'
shingles fill the window, the similarity is at least 0.19 and the chance 0.001. ``exact=True`` takes every pair
that shares a shingle as a candidate instead, which misses none.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z folded. A text of fewer than ``k`` words is one shingle, so
such an item is found only as a whole text. Null or empty texts and null ids contain nothing and are
contained nowhere. Rows that share an id are taken together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.llm import bitset
from oddlot.llm.store import written
from oddlot.llm.tokens import all_shingles, find_words, flat, lists, mix, slices

FUNCTIONS = 32
_XOR = mix(np.arange(1, FUNCTIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_TIMES = mix(np.arange(1001, 1001 + FUNCTIONS, dtype=np.uint64)) | np.uint64(1)


def _listed(bits, x: np.ndarray) -> np.ndarray:
    return bitset.listed(bits.value, x & np.uint64(bitset.BITS - 1))


def _bits(df: DataFrame, column: str):
    return bitset.build(df.select(F.explode(column).alias("x")), F.col("x").bitwiseAND(F.lit(bitset.BITS - 1)))


def _minima(values: np.ndarray, starts: np.ndarray, function: int) -> np.ndarray:
    return np.minimum.reduceat((values ^ _XOR[function]) * _TIMES[function], starts)


def _key(least: np.ndarray, function: int, size_class: int) -> np.ndarray:
    return mix(least + np.uint64((size_class * FUNCTIONS + function + 1) * 0x2545F4914F6CDD1D & 0xFFFFFFFFFFFFFFFF))


def _size_class(n: int) -> int:
    return int(n).bit_length() - 1


def _items(k: int):
    """Distinct shingles and sketch keys of each item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = flat(batch.column("item_id"))
            for i, j, data, offsets in slices(batch.column("text")):
                words = find_words(data, offsets)
                values, begin = all_shingles(words.hashes(lower=True), words.first, k)
                rows = np.flatnonzero(np.diff(begin))
                sets = [np.unique(values[begin[d] : begin[d + 1]]) for d in rows]
                classes = [_size_class(len(own)) for own in sets]
                start = np.zeros(1, dtype=np.int64)
                keys = [
                    np.concatenate([_key(_minima(own, start, f), f, c) for f in range(FUNCTIONS)])
                    for own, c in zip(sets, classes, strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(rows + i)), pa.array(classes, pa.int32()), lists(sets), lists(keys)],
                    names=["item_id", "size_class", "shingles", "keys"],
                )

    return run


def windows(values: np.ndarray, begin: np.ndarray, size_class: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sketch keys of the windows of rows that hold any value, and the row of each; one pair per function."""
    block = 2 << size_class
    blocks = -(-np.diff(begin) // block)
    at = np.concatenate(([0], np.cumsum(blocks)))
    owner = np.repeat(np.arange(len(blocks)), blocks)
    starts = begin[owner] + (np.arange(at[-1]) - at[owner]) * block
    same = owner[1:] == owner[:-1]
    for f in range(FUNCTIONS):
        least = _minima(values, starts, f)
        least[:-1] = np.where(same, np.minimum(least[:-1], least[1:]), least[:-1])
        yield _key(least, f, size_class), owner


def _documents(k: int, classes: list[int], shingle_bits, key_bits):
    """Shingles of each row that may occur in an item, and the sketch keys that may be an item's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = flat(batch.column("doc_id"))
            for i, j, data, offsets in slices(batch.column("text")):
                words = find_words(data, offsets)
                values, begin = all_shingles(words.hashes(lower=True), words.first, k)
                hit = np.flatnonzero(_listed(shingle_bits, values))
                begin = np.searchsorted(hit, begin)
                rows = np.flatnonzero(np.diff(begin))
                if not len(rows):
                    continue
                values, begin = values[hit], np.append(begin[rows], begin[-1])
                found, owners = [np.zeros(0, dtype=np.uint64)], [np.zeros(0, dtype=np.int64)]
                for c in classes:
                    for keys, owner in windows(values, begin, c):
                        near = np.flatnonzero(_listed(key_bits, keys))
                        found.append(keys[near])
                        owners.append(owner[near])
                found, owners = np.concatenate(found), np.concatenate(owners)
                order = np.argsort(owners, kind="stable")
                cut = np.searchsorted(owners[order], np.arange(len(rows) + 1))
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(rows + i)),
                        lists([np.unique(values[begin[x] : begin[x + 1]]) for x in range(len(rows))]),
                        lists([np.unique(found[order[cut[x] : cut[x + 1]]]) for x in range(len(rows))]),
                    ],
                    names=["doc_id", "shingles", "keys"],
                )

    return run


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80, exact: bool = False) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared`` for every item found in a document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    wanted = written(
        items.select(F.col("item_id").cast("long").alias("item_id"), "text")
        .filter("item_id is not null")
        .mapInArrow(_items(k), "item_id long, size_class int, shingles array<long>, keys array<long>")
    )
    # At most one class per bit of a size.
    classes = [] if exact else sorted(r[0] for r in wanted.select("size_class").distinct().collect())
    listed = [_bits(wanted, c) for c in ("shingles", "keys")]
    seen = written(texts.mapInArrow(_documents(k, classes, *listed), "doc_id long, shingles array<long>, keys array<long>"))
    for bits in listed:
        bits.unpersist()
    item_shingles = wanted.select("item_id", F.explode("shingles").alias("shingle")).distinct()
    shingles = seen.select("doc_id", F.explode("shingles").alias("shingle")).distinct()
    sizes = item_shingles.groupBy("item_id").agg(F.count("*").alias("n_item"))
    if exact:
        met = shingles.join(item_shingles, "shingle")
    else:
        item_keys = wanted.select("item_id", F.explode("keys").alias("key")).distinct()
        found = seen.select("doc_id", F.explode("keys").alias("key")).join(item_keys, "key")
        candidates = written(found.select("doc_id", "item_id").distinct())
        met = candidates.join(item_shingles, "item_id").join(shingles, ["doc_id", "shingle"])
    return (
        met.groupBy("doc_id", "item_id")
        .agg(F.count("*").alias("n_shared"))
        .join(sizes, "item_id")
        .filter(F.col("n_shared") * 100 >= F.col("n_item") * percent)
        .select("doc_id", "item_id", "n_item", "n_shared")
    )


def without_items(docs: DataFrame, items: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that contain no item; rows without an id stay."""
    found = contained_items(docs, items, k, percent).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)
