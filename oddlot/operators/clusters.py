"""k-means with an elbow rule, and a spherical Gaussian mixture."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import add, and_
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from oddlot.columns import CUSTOMER
from oddlot.operators.rfm import RFM, customer_rfm, merchant_rfm
from oddlot.operators.skew import HotKeys
from oddlot.operators.stats import with_iqr_outlier
from oddlot.session import settle

# Number of clusters tried, and the multiplier of the standard error.
MAX_K = 9
ERROR_WIDTH = 2.58
FIXED_BITS = 30
KMEANS_ROUNDS = 300
ROWS_PER_TASK = 50_000

MIXTURE_PARTS = 4
MIXTURE_STEPS = 100
MIXTURE_TOLERANCE = 1e-3
MIXTURE_FLOOR = 1e-6
# Bits of a weighted value and of a fraction of a log-likelihood; a batch of 10,000 rows cannot overflow.
SUM_BITS = 40
LIKELIHOOD_BITS = 16


def knee(sweep: DataFrame, param: str, metric: str, smallest: bool = True) -> DataFrame:
    """The parameter after which the metric stops falling noticeably; null if there is none.

    ``sweep`` is a table of tried parameters (at most a few hundred rows), so ordering it in one
    window is bounded.
    """
    steps = sweep.select(
        param, (F.lag(metric).over(W.orderBy(param)) - F.col(metric)).alias("drop")
    ).where(F.col("drop").isNotNull())
    error = steps.agg(
        (F.lit(ERROR_WIDTH) * F.stddev_pop("drop") / F.sqrt(F.count("drop"))).alias("e")
    ).scalar()
    pick = F.min(param) if smallest else F.max(param)
    return steps.where(F.col("drop") < error).agg(pick.alias(param))


def chosen(sweep: DataFrame, param: str, metric: str, smallest: bool = True, otherwise: str = "largest"):
    """Value of the knee rule, or the largest or smallest tried parameter without a knee."""
    value = knee(sweep, param, metric, smallest).first()[0]
    if value is None:
        value = sweep.agg(F.max(param) if otherwise == "largest" else F.min(param)).first()[0]
    return value


def squared_distance(columns: list[str], center: list[float]) -> Column:
    return reduce(add, [(F.col(c) - F.lit(float(m))) ** 2 for c, m in zip(columns, center)])


def fixed_points(points: DataFrame, columns: list[str]) -> tuple[DataFrame, float]:
    """The complete rows as whole numbers of up to 30 bits, and the power of two they were multiplied by.

    Sums of whole numbers are exact in any order, so centres do not depend on partitions.
    """
    whole = reduce(and_, [F.col(c).isNotNull() & (F.abs(F.col(c)) < math.inf) for c in columns])
    points = points.select(*columns).where(whole)
    largest = F.max(F.greatest(*[F.abs(c) for c in columns], F.lit(0.0)))
    top, n = points.agg(largest, F.count(F.lit(1))).first()
    scale = 2.0 ** (FIXED_BITS - math.ceil(math.log2(top))) if top else 1.0
    fixed = [F.floor(F.col(c) * scale + 0.5).cast("long").alias(c) for c in columns]
    # Every round starts all tasks anew, so they are as few as the rows bear.
    return settle(points.select(*fixed).coalesce(max(1, -(-n // ROWS_PER_TASK)))), scale


def point_blocks(fixed: DataFrame, columns: list[str]) -> RDD:
    """The points as arrays of whole numbers, a row per point and an array per Arrow batch.

    k-means passes over them once a round. The work of a round is small, so it runs on what is kept here,
    without a plan to be made and compiled anew each time.
    """
    width = len(columns)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy() for c in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary())], names=["x"])

    rows = fixed.select(*columns).mapInArrow(packed, "x binary").rdd
    return rows.map(lambda r: np.frombuffer(r["x"], dtype=np.int64).reshape(-1, width)).persist(StorageLevel.MEMORY_AND_DISK)


def _squares(x: np.ndarray, centers: list[list[float]]) -> np.ndarray:
    """Squared distances of points to centres, added up axis by axis."""
    square = np.zeros((len(x), len(centers)))
    for j in range(x.shape[1]):
        away = x[:, j, None].astype(float) - np.array([c[j] for c in centers])[None, :]
        square += away * away
    return square


def _added(a: dict, b: dict) -> dict:
    """Sums by key; Python's whole numbers have no bounds, so they are exact in any order."""
    both = dict(a)
    for at, values in b.items():
        both[at] = [p + q for p, q in zip(both[at], values)] if at in both else values
    return both


def _combined(blocks: RDD, of_block: Callable[[np.ndarray], Any], join: Callable[[Any, Any], Any]) -> Any:
    """What ``of_block`` finds in each block, joined within tasks and then in a tree; None without points."""

    def of_task(parts: Iterator[np.ndarray]) -> Iterator[Any]:
        found = [of_block(x) for x in parts if len(x)]
        yield reduce(join, found) if found else None

    return blocks.mapPartitions(of_task).treeReduce(lambda a, b: b if a is None else a if b is None else join(a, b))


def _size_and_sums(x: np.ndarray) -> list[int]:
    """Whole numbers of 30 bits: a block cannot overflow."""
    return [len(x), *map(int, x.sum(axis=0))]


def _mean(values: list[int]) -> list[float]:
    return [float(v) / float(values[0]) for v in values[1:]]


def farthest_seeds(blocks: RDD, many: int) -> list[list[float]]:
    """The point farthest from the mean, then always the one farthest from all seeds before.

    Of equally far points the smallest by coordinates is taken. There are at most as many seeds as
    distinct points. Each seed is one pass, to which a task adds one point.
    """
    total = _combined(blocks, lambda x: {0: _size_and_sums(x)}, _added)
    if total is None:
        return []
    seeds: list[list[float]] = []
    origins = [_mean(total[0])]

    def farthest(x: np.ndarray) -> tuple:
        square = _squares(x, origins).min(axis=1)
        top = square.max()
        return (float(top), *max(tuple(-v for v in map(int, p)) for p in np.unique(x[square == top], axis=0)))

    while len(seeds) < many:
        d, *point = _combined(blocks, farthest, max)
        if seeds and d == 0:
            break
        seeds.append([-float(v) for v in point])
        origins = seeds
    return seeds


def _nearest_sums(blocks: RDD, centers: dict[int, list[list[float]]]) -> dict[tuple[int, int], list[int]]:
    """Per k and centre ``i`` that has points: number and sums of the points nearest to it."""

    def sums(x: np.ndarray) -> dict[tuple[int, int], list[int]]:
        found = {}
        for k, of_k in centers.items():
            own = _squares(x, of_k).argmin(axis=1)
            for i in np.unique(own):
                found[k, int(i)] = _size_and_sums(x[own == i])
        return found

    return _combined(blocks, sums, _added)


def lloyd(blocks: RDD, seeds: list[list[float]], ks: Iterable[int]) -> dict[int, list[list[float]]]:
    """Centres of every k in the units of ``blocks``, in the order of the seeds.

    All k move in the same passes: a round adds up sums by (k, nearest centre) over the k that still
    move, and brings home one list of sums per centre. A centre without points stays; of equally
    near centres the earlier seed takes a point.
    """
    centers = {k: seeds[:k] for k in ks if k <= len(seeds)}
    moving = set(centers)
    for _ in range(KMEANS_ROUNDS):
        if not moving:
            break
        moved = {k: list(centers[k]) for k in moving}
        for (k, i), values in _nearest_sums(blocks, {k: centers[k] for k in sorted(moving)}).items():
            moved[k][i] = _mean(values)
        moving = {k for k in moving if moved[k] != centers[k]}
        centers.update({k: moved[k] for k in moving})
    return centers


def _unscaled(centers: list[list[float]], scale: float) -> list[list[float]]:
    return sorted([v / scale for v in c] for c in centers)


def kmeans(points: DataFrame, columns: list[str], ks: Iterable[int]) -> dict[int, list[list[float]]]:
    """Centres in ascending order of every k that has enough distinct points, from the same seeds."""
    fixed, scale = fixed_points(points, columns)
    blocks = point_blocks(fixed, columns)
    found = lloyd(blocks, farthest_seeds(blocks, max(ks)), ks)
    blocks.unpersist()
    return {k: _unscaled(c, scale) for k, c in found.items()}


def nearest(columns: list[str], centers: list[list[float]]) -> Column:
    """Index of the nearest centre."""
    ranked = [
        F.struct(squared_distance(columns, c).alias("d"), F.lit(i).alias("i"))
        for i, c in enumerate(centers)
    ]
    return (F.least(*ranked) if len(ranked) > 1 else ranked[0])["i"]


def center_distance(columns: list[str], centers: list[list[float]]) -> Column:
    """Euclidean distance to the nearest centre."""
    squares = [squared_distance(columns, c) for c in centers]
    return F.sqrt(F.least(*squares) if len(squares) > 1 else squares[0])


def sweep_k(points: DataFrame, columns: list[str], max_k: int = MAX_K) -> tuple[DataFrame, dict]:
    """Mean distance to the nearest centre for k = 1..max_k, and the centres of each k.

    k stops at the number of distinct points.
    """
    fits = kmeans(points, columns, range(1, max_k + 1))
    schema = "k int, distance double"
    if not fits:
        return points.sparkSession.createDataFrame([], schema), fits
    row = points.agg(
        *[F.avg(center_distance(columns, c)).alias(str(k)) for k, c in fits.items()]
    ).first()
    return points.sparkSession.createDataFrame([(k, row[str(k)]) for k in fits], schema), fits


def cluster_merchants(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """RFM and ``merchant_label`` per merchant, with k chosen by the elbow rule."""
    # Read in every round, so written once: one row per merchant.
    rfm = settle(merchant_rfm(df, hot))
    columns = ["recency", "monetary", "frequency"]
    renamed = {m: f"m_{m}" for m in RFM}
    table, fits = sweep_k(rfm, columns)
    if not fits:
        return rfm.withColumn("merchant_label", F.lit(None).cast("int")).withColumnsRenamed(renamed)
    k = chosen(table, "k", "distance") if len(fits) > 2 else len(fits)
    return rfm.withColumn("merchant_label", nearest(columns, fits[k])).withColumnsRenamed(renamed)


@dataclass(frozen=True)
class Mixture:
    columns: tuple[str, ...]
    weights: tuple[float, ...]
    means: tuple[tuple[float, ...], ...]
    variances: tuple[float, ...]


def _log_parts(model: Mixture) -> list[Column]:
    """Log of weight times density per component."""
    d = len(model.columns)
    return [
        F.lit(math.log(w) - 0.5 * d * (math.log(2 * math.pi) + math.log(v)))
        - squared_distance(list(model.columns), list(m)) / F.lit(2.0 * v)
        for w, m, v in zip(model.weights, model.means, model.variances)
    ]


def with_responsibilities(points: DataFrame, model: Mixture) -> DataFrame:
    """Add ``responsibility`` (array), the hard ``label`` and ``log_likelihood``."""
    parts = F.array(*_log_parts(model))
    out = points.withColumn("__p", parts).withColumn("__m", F.array_max("__p"))
    out = out.withColumn(
        "log_likelihood",
        F.col("__m")
        + F.log(F.aggregate("__p", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("__m")))),
    )
    return (
        out.withColumn(
            "responsibility", F.transform("__p", lambda x: F.exp(x - F.col("log_likelihood")))
        )
        .withColumn("label", (F.array_position("__p", F.col("__m")) - 1).cast("int"))
        .drop("__p", "__m")
    )


def _log_densities(model: Mixture, x: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    square = ((x[:, None, :] - np.array(model.means)[None, :, :]) ** 2).sum(axis=2)
    v = np.array(model.variances)
    return np.log(model.weights) - 0.5 * d * np.log(2 * math.pi * v) - square / (2 * v)


def _maximised(fixed: DataFrame, scale: float, columns: tuple[str, ...], parts: int, shares: Callable) -> tuple[Mixture, float]:
    """New parameters from one aggregate by component, and the mean log-likelihood.

    ``shares(x)`` returns each row's weight per component and its log-likelihood. Every weighted value
    becomes a whole number of ``SUM_BITS`` bits before it is added, so sums do not depend on partitions.
    """
    up, down = 2.0 ** (SUM_BITS - FIXED_BITS), 2.0 ** (SUM_BITS - 2 * FIXED_BITS)
    names = ["__n", "__l", "__m", *columns, "__q"]

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = [[0] * len(names) for _ in range(parts)]
        for batch in batches:
            x = batch.to_numpy(dtype=float)
            size = (x * x).sum(axis=1)
            r, likelihood = shares(x / scale)
            total[0][0] += len(x)
            bounded = np.clip(likelihood, -(2.0**30), 2.0**30)
            total[0][1] += int(np.floor(bounded * 2.0**LIKELIHOOD_BITS + 0.5).astype(np.int64).sum())
            for i in range(parts):
                own = r[:, i]
                values = [own * 2.0**SUM_BITS, *[own * x[:, j] * up for j in range(x.shape[1])], own * size * down]
                for at, value in enumerate(values, 2):
                    total[i][at] += int(np.floor(value + 0.5).astype(np.int64).sum())
        yield pd.DataFrame([(i, *map(Decimal, t)) for i, t in enumerate(total)], columns=["i", *names])

    whole = ", ".join(f"`{c}` decimal(28,0)" for c in names)
    totals = [F.sum(F.col(f"`{c}`")).alias(c) for c in names]
    found = fixed.select(*columns).mapInPandas(sums, f"i int, {whole}").groupBy("i").agg(*totals).collect()
    rows = sorted(found, key=lambda r: r["i"])
    n = float(rows[0]["__n"])
    likelihood = float(rows[0]["__l"]) / 2.0**LIKELIHOOD_BITS / n
    mass = np.array([float(r["__m"]) for r in rows]) / 2.0**SUM_BITS + 10 * np.finfo(float).eps
    means = np.array([[float(r[c]) for c in columns] for r in rows]) / up / scale / mass[:, None]
    size = np.array([float(r["__q"]) for r in rows]) / down / scale**2 / mass
    variances = np.maximum((size - (means**2).sum(axis=1)) / len(columns), 0.0) + MIXTURE_FLOOR
    model = Mixture(
        columns,
        tuple((mass / n).tolist()),
        tuple(tuple(m) for m in means.tolist()),
        tuple(variances.tolist()),
    )
    return model, likelihood


def fit_mixture(
    points: DataFrame, columns: list[str], parts: int = MIXTURE_PARTS
) -> Mixture | None:
    """Expectation-maximisation from k-means of farthest-point seeds; each iteration is one aggregate.

    Rows with a null or non-finite value take no part. With fewer distinct rows than components there
    are fewer components; ``None`` without rows. The result does not depend on partitions.
    """
    fixed, scale = fixed_points(points, columns)
    blocks = point_blocks(fixed, columns)
    seeds = farthest_seeds(blocks, parts)
    k = len(seeds)
    found = lloyd(blocks, seeds, [k] if k else [])
    blocks.unpersist()
    if not seeds:
        return None
    centers = np.array(_unscaled(found[k], scale))

    def hard(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        nearest_center = ((x[:, None, :] - centers[None, :, :]) ** 2).sum(axis=2).argmin(axis=1)
        return np.eye(k)[nearest_center], np.zeros(len(x))

    model, _ = _maximised(fixed, scale, tuple(columns), k, hard)
    before = -math.inf
    for _ in range(MIXTURE_STEPS):
        current = model

        def soft(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            logs = _log_densities(current, x)
            top = logs.max(axis=1, keepdims=True)
            likelihood = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
            return np.exp(logs - likelihood[:, None]), likelihood

        model, likelihood = _maximised(fixed, scale, tuple(columns), k, soft)
        if abs(likelihood - before) < MIXTURE_TOLERANCE:
            break
        before = likelihood
    return model


def customer_mixture_scores(
    df: DataFrame, feature: str = "gmm", hot: HotKeys | None = None
) -> DataFrame:
    """Per customer, 1 - probability of its own component; 1 for customers outside the fences."""
    columns = list(RFM)
    # Read by the fit and by the scores, so written once: one row per customer.
    marked = settle(with_iqr_outlier(settle(customer_rfm(df, hot)), columns, "__out"))
    inliers = marked.where(~F.col("__out"))
    model = fit_mixture(inliers, columns)
    outliers = marked.where("__out").select(CUSTOMER, F.lit(1.0).alias(feature))
    if model is None:
        return outliers
    own = F.array_max("responsibility")
    scored = with_responsibilities(inliers, model).select(CUSTOMER, (1 - own).alias(feature))
    return scored.unionByName(outliers)
