"""Embedding near-dedup by lattice hashing.

A unit vector is projected at random to ``BLOCKS`` times eight dimensions per table, and each block of
eight is decoded to its nearest point of the E8 lattice; the lattice points of a table together are the
vector's cell. A vector also enters ``PROBES`` neighbouring cells per table: those where one block's
point is replaced by a neighbouring lattice point, nearest first. Vectors that meet in a cell are
candidates and are verified by their cosine in double precision.

* Equal vectors are collapsed to the smallest id with their number before anything else.
* A cell's vectors are compared in tiles of bounded size; a tile returns only links that join what was
  apart, so a cell of many near copies gives fewer rows than it has members.
* Components follow from these links. Within each component all pairs are then compared once more, in
  tiles that return sums per vector, to count every direct link, found by a cell or not.

A pair is missed only if its vectors meet in no cell of any table and are joined by no other links.
Recall of direct links is measured in the tests against brute force.

Vectors that are null, all zero, or hold null or non-finite numbers are linked with nothing; so is a row
with a null id, which has a null component. Vectors of different lengths are never linked. Rows of one
id count as one node; repeated rows of one id and vector count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.llm.graph import connected
from oddlot.llm.parity_join import _forest
from oddlot.llm.store import written
from oddlot.llm.tokens import flat, lists, mix, number_mix

TABLES = 8
BLOCKS = 3
PROBES = 5
SCALE = 0.6
#: Vectors in a slice of a cell or component that are compared with one another.
TILE = 1024


def _half_rows() -> np.ndarray:
    """The 240 shortest vectors of E8."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for bits in range(256):
        signs = np.array([0.5 if bits >> k & 1 else -0.5 for k in range(8)])
        if (signs < 0).sum() % 2 == 0:
            out.append(signs)
    return np.array(out)


SHORTEST = _half_rows()


def _even_integers(y: np.ndarray) -> np.ndarray:
    """The nearest point of D8: integers with an even sum."""
    near = np.rint(y)
    odd = np.flatnonzero(near.sum(axis=1) % 2 != 0)
    off = y[odd] - near[odd]
    worst = np.abs(off).argmax(axis=1)
    rows = np.arange(len(odd))
    near[odd, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return near


def nearest(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point of each row: of D8 or of D8 shifted by halves."""
    a, b = _even_integers(y), _even_integers(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


@lru_cache(maxsize=8)
def _projections(size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((TABLES, BLOCKS, size, 8)) * SCALE


def _codes(points: np.ndarray) -> np.ndarray:
    """A hash of each row of lattice points, whose doubled coordinates are small integers."""
    whole = (2 * points).astype(np.int64).view(np.uint64)
    factors = mix(np.arange(1, 9, dtype=np.uint64)) | np.uint64(1)
    return mix((whole * factors).sum(axis=1, dtype=np.uint64))


def cells(x: np.ndarray, seed: int = 9) -> np.ndarray:
    """Keys of the cells of each unit vector: one row per vector, ``TABLES * (1 + PROBES)`` columns."""
    n, size = x.shape
    out = np.empty((n, TABLES, 1 + PROBES), dtype=np.uint64)
    rows = np.arange(n)
    for t in range(TABLES):
        own, other, cost = [], [], []
        for b in range(BLOCKS):
            y = x @ _projections(size, seed)[t, b]
            point = nearest(y)
            gain = (y - point) @ SHORTEST.T
            best = np.argpartition(-gain, PROBES, axis=1)[:, :PROBES]
            own.append(_codes(point))
            cost.append(-np.take_along_axis(gain, best, axis=1))
            other.append(np.stack([_codes(point + SHORTEST[best[:, p]]) for p in range(PROBES)], axis=1))
        salt = [number_mix(1000 + b) for b in range(BLOCKS)]
        parts = [mix(own[b] ^ salt[b]) for b in range(BLOCKS)]
        base = sum(parts[1:], parts[0].copy())
        table = number_mix((2000 + t) * 1_000_003 + size)
        out[:, t, 0] = mix(base + table)
        costs = np.concatenate(cost, axis=1)
        moved = np.concatenate([base[:, None] - parts[b][:, None] + mix(other[b] ^ salt[b]) for b in range(BLOCKS)], axis=1)
        order = np.argsort(costs, axis=1, kind="stable")[:, :PROBES]
        for p in range(PROBES):
            out[:, t, 1 + p] = mix(moved[rows, order[:, p]] + table)
    return out.reshape(n, -1)


def _matrix(column: pa.Array) -> np.ndarray:
    column = flat(column)
    begin = column.offsets.to_numpy()
    return column.values.to_numpy()[begin[0] : begin[-1]].reshape(len(column), -1).astype(np.float64)


def _cells(seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = flat(batch.column("embedding"))
            sizes = np.diff(vectors.offsets.to_numpy())
            for size in np.unique(sizes):
                for rows in np.array_split(np.flatnonzero(sizes == size), max(1, (sizes == size).sum() // 2000)):
                    x = _matrix(vectors.take(pa.array(rows)))
                    x /= np.linalg.norm(x, axis=1, keepdims=True)
                    keys = cells(x, seed)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("rep").take(pa.array(rows)), lists(list(keys))], names=["rep", "keys"]
                    )

    return run


def _tiles(df: DataFrame, group: str) -> DataFrame:
    """Rows with the tiles they are compared in: one slice of a group, or two."""
    parts = df.groupBy(group).agg(F.ceil(F.count("*") / TILE).alias("parts"), F.count("*").alias("members")).filter("members > 1")
    return (
        df.join(parts.drop("members"), group)
        .withColumn("own", F.pmod(F.xxhash64("rep", F.lit(29)), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")})
        .drop("parts", "other")
    )


def _near(tile: pa.Table, cosine: float) -> np.ndarray:
    """Which rows of a tile are linked, as a symmetric matrix; within a slice, or across two."""
    x = _matrix(tile.column("embedding"))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= cosine
    np.fill_diagonal(linked, False)
    if tile.column("low")[0].as_py() != tile.column("high")[0].as_py():
        own = tile.column("own").to_numpy()
        linked &= own[:, None] != own[None, :]
    return linked


def _joins(cosine: float):
    def run(tile: pa.Table) -> pa.Table:
        rep = tile.column("rep").to_numpy()
        linked = np.triu(_near(tile, cosine))
        pairs = _forest(list(zip(*(x.tolist() for x in np.nonzero(linked)), strict=True)), len(rep))
        ends = np.array(pairs, dtype=np.int64).reshape(-1, 2)
        return pa.table({"u": pa.array(rep[ends[:, 0]]), "v": pa.array(rep[ends[:, 1]])})

    return run


def _counts(cosine: float):
    def run(tile: pa.Table) -> pa.Table:
        links = _near(tile, cosine) @ tile.column("copies").to_numpy()
        return pa.table({"rep": tile.column("rep"), "links": pa.array(links.astype(np.int64))})

    return run


def _dot(x: str, y: str) -> F.Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda total, v: total + v)


def near_vectors(vectors: DataFrame, cosine: float = 0.95, seed: int = 9) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors(vec_id, embedding, ...)``."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    zero = F.forall("embedding", lambda v: v == 0)
    usable = F.col("vec_id").isNotNull() & F.coalesce(fine & ~zero & (F.size("embedding") > 0), F.lit(False))
    marked = rows.select("vec_id", F.when(usable, F.col("embedding")).alias("embedding"))
    known = marked.filter("embedding is not null").distinct()
    reps = written(known.groupBy("embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")))
    members = written(known.join(reps, "embedding").select("vec_id", "rep", "copies"))

    keyed = reps.select("rep", "embedding").mapInArrow(_cells(seed), "rep long, keys array<long>")
    cell_rows = written(keyed.select("rep", F.explode(F.array_distinct("keys")).alias("key")))
    shared = written(
        cell_rows.groupBy("key").agg(F.min("rep").alias("u"), F.max("rep").alias("v"), F.count("*").alias("n")).filter("n > 1")
    )
    met = written(cell_rows.join(shared.filter("n > 2").select("key"), "key"))
    tiled = _tiles(met, "key").join(reps.select("rep", "embedding"), "rep")
    links = tiled.groupBy("key", "low", "high").applyInArrow(_joins(cosine), "u long, v long").distinct()
    # Most cells hold just two vectors, and two near ones meet in many cells; such a pair is tried once.
    pairs = (
        shared.filter("n = 2").select("u", "v").distinct()
        .join(reps.select(F.col("rep").alias("u"), F.col("embedding").alias("x")), "u")
        .join(reps.select(F.col("rep").alias("v"), F.col("embedding").alias("y")), "v")
        .filter((F.size("x") == F.size("y")) & (_dot("x", "y") >= cosine * F.sqrt(_dot("x", "x")) * F.sqrt(_dot("y", "y"))))
    )
    links = links.unionByName(pairs.select("u", "v"))
    # Rows of one id hold different vectors; the id is one node.
    same = members.filter("vec_id != rep").select(F.col("vec_id").alias("u"), F.col("rep").alias("v"))
    components = connected(links.unionByName(same))

    grouped = written(
        reps.join(components, reps.rep == components.node).select("rep", "embedding", "copies", "component")
    )
    counted = (
        _tiles(grouped, "component")
        .groupBy("component", "low", "high")
        .applyInArrow(_counts(cosine), "rep long, links long")
        .groupBy("rep")
        .agg(F.sum("links").alias("links"))
    )
    direct = (
        members.join(counted, "rep", "left")
        .groupBy("vec_id")
        .agg(F.sum(F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    return (
        rows.select("vec_id")
        .join(direct, "vec_id", "left")
        .join(components.select(F.col("node").alias("vec_id"), "component"), "vec_id", "left")
        .select(
            "vec_id",
            F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
            F.coalesce("component", "vec_id").alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    )
