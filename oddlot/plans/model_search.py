"""Supervised model selection: grids per family, a leaderboard, and a stacked ensemble."""

from __future__ import annotations

import math
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product
from typing import Any

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Model
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from oddlot.columns import ID
from oddlot.detectors.dense_net import Lesson, Net, fit_net, fit_nets, regression_net, with_output
from oddlot.functions.scalars import md5_unit
from oddlot.operators.ranking import with_row_index

# Folds, seed, and the rounds of boosting without gain after which it stops.
FOLDS = 5
SEED = 1234
PATIENCE = 10
VALIDATION_SHARE = 0.1
PARALLEL_FITS = 4


@dataclass
class Best:
    """The winner of one family's grid."""

    family: str
    params: dict[str, Any]
    cv_mse: float
    model: Any


def with_folds(df: DataFrame, folds: int = FOLDS, ident: str = ID) -> DataFrame:
    """Fold = position of the row in id order, modulo the number of folds."""
    indexed = with_row_index(df, [ident], "__row")
    return indexed.withColumn("fold", F.pmod(F.col("__row"), F.lit(folds)).cast("int")).drop("__row")


def assembled(df: DataFrame, features: list[str], target: str, ident: str = ID) -> DataFrame:
    """Vector column, label, and the rows boosted trees use to decide when to stop."""
    ready = VectorAssembler(inputCols=features, outputCol="x", handleInvalid="skip").transform(df)
    stop = md5_unit(F.col(ident), SEED + 1) < VALIDATION_SHARE
    return ready.withColumn("y", F.col(target).cast("double")).withColumn("stop", stop)


def _combos(grid: dict[str, list]) -> list[dict[str, Any]]:
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def _ranked(
    train: DataFrame, family: str, combos: list[dict[str, Any]], errors: list[float], fit: Callable[[dict], Any]
) -> tuple[DataFrame, Best]:
    """The board of a family's combinations, and its best one fitted to all of ``train``."""
    rows = [(family, str(p), float(e)) for p, e in zip(combos, errors)]
    table = train.sparkSession.createDataFrame(rows, "family string, params string, mse double")
    at = min(range(len(rows)), key=lambda i: (rows[i][2], i))
    return table.orderBy("mse", "params"), Best(family, combos[at], rows[at][2], fit(combos[at]))


def grid_search(
    family: str, train: DataFrame, grid: dict[str, list], folds: int = FOLDS
) -> tuple[DataFrame, Best]:
    """Cross-validated mean squared error of every combination, and the refitted best.

    ``train`` holds ``x``, ``y``, ``stop`` and ``fold``, and should be persisted.
    """
    if family == "gbt":
        return _grid_boosted(train, grid, folds)
    if family == "glm":
        return _grid_linear(train, grid, folds)
    if family != "rf":
        raise KeyError(f"no family named {family!r}")
    estimator = RandomForestRegressor(featuresCol="x", labelCol="y", seed=SEED)
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    maps = builder.build()
    search = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=maps,
        evaluator=RegressionEvaluator(labelCol="y", metricName="mse"),
        numFolds=folds,
        foldCol="fold",
        parallelism=PARALLEL_FITS,
    ).fit(train)
    named = [{p.name: v for p, v in combo.items()} for combo in maps]
    return _ranked(train, family, named, search.avgMetrics, lambda _: search.bestModel)


# ---- boosted trees ------------------------------------------------------------------------------


def kept_rounds(curve: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """Rounds up to the lowest error reached before ``patience`` rounds brought no gain, and whether
    the curve is long enough to tell."""
    best = 0
    for i, error in enumerate(curve):
        if error < curve[best]:
            best = i
        elif i - best >= patience:
            return best + 1, True
    return best + 1, False


@dataclass
class BinnedTrees:
    """Boosted trees over the numbers of bins, and the borders of the bins of each feature."""

    trees: Any
    borders: list[list[float]]

    @property
    def getNumTrees(self) -> int:
        return self.trees.getNumTrees

    def transform(self, df: DataFrame) -> DataFrame:
        x, names = vector_to_array(F.col("x")), [f"__v{i}" for i in range(len(self.borders))]
        ready = _binned(df.withColumns({n: x[i] for i, n in enumerate(names)}), names, self.borders)
        bins = [f"b_{n}" for n in names]
        return self.trees.transform(ready.withColumn("__bins", _vector(bins))).drop(*names, *bins, "__bins")


@dataclass
class Boosting:
    """Boosted trees, the error of the rows set aside after each round, and the rounds that count."""

    model: BinnedTrees
    curve: list[float]
    rounds: int


# Rows whose values decide where the bins of a feature begin; trees in Spark look at as many.
BORDER_ROWS = 10_000


def borders(counts: list[tuple[float, int]], most: int) -> list[float]:
    """Cuts between the values of a feature, ascending with their rows, for at most ``most`` bins.

    As in Spark's trees: between all neighbouring values or, if these are too many, wherever the rows
    below come closest to the next equal share.
    """
    middles = [(a[0] + b[0]) / 2 for a, b in zip(counts, counts[1:])]
    if len(counts) <= most:
        return middles
    share = sum(n for _, n in counts) / most
    out, below, wanted = [], counts[0][1], share
    for middle, (_, n) in zip(middles, counts[1:]):
        if abs(below - wanted) < abs(below + n - wanted):
            out.append(middle)
            wanted += share
        below += n
    return out


def _width(train: DataFrame) -> int:
    width = train.schema["x"].metadata.get("ml_attr", {}).get("num_attrs")
    if width is None:
        first = train.select(F.size(vector_to_array("x")).alias("w")).first()
        width = first["w"] if first else 0
    return width


def _plain(train: DataFrame, ident: str) -> DataFrame:
    """The features as columns of their own, with what boosting needs besides."""
    x = vector_to_array(F.col("x"))
    kept = [c for c in (ident, "y", "stop", "fold") if c in train.columns]
    return train.select(*kept, *[x[i].alias(f"v{i}") for i in range(_width(train))])


def _features(plain: DataFrame) -> list[str]:
    return [c for c in plain.columns if c[0] == "v" and c[1:].isdigit()]


def _binned(df: DataFrame, names: list[str], cuts: list[list[float]]) -> DataFrame:
    """For each feature, in ``b_`` and its name, how many of its cuts lie below the value."""
    some = [n for n, c in zip(names, cuts) if c]
    if some:
        # Buckets begin at their edge, bins of trees just above it.
        edges = [[-math.inf, *np.nextafter(c, math.inf).tolist(), math.inf] for c in cuts if c]
        df = Bucketizer(splitsArray=edges, inputCols=some, outputCols=[f"b_{n}" for n in some]).transform(df)
    return df.withColumns({f"b_{n}": F.lit(0.0) for n in names if n not in some})


def _vector(names: list[str]) -> Column:
    return array_to_vector(F.array(*names))


def _all_borders(plain: DataFrame, n: int, most: int, ident: str) -> list[list[float]]:
    """Borders of every feature from all ``n`` rows, or from some ``BORDER_ROWS`` of them by a hash."""
    names = _features(plain)
    if n > BORDER_ROWS:
        keys = [F.col(c) for c in (ident, "y", *names) if c in plain.columns]
        # 40 bits of the hash of a row against the share of rows wanted.
        plain = plain.where(F.pmod(F.xxhash64(*keys, F.lit(SEED)), F.lit(1 << 40)) < int(BORDER_ROWS / n * (1 << 40)))
    # At most the values of the rows chosen come home.
    tall = plain.select(F.posexplode(F.array(*names)).alias("feature", "value"))
    found: list[list[tuple[float, int]]] = [[] for _ in names]
    for row in tall.groupBy("feature", "value").count().collect():
        found[row["feature"]].append((row["value"], row["count"]))
    return [borders(sorted(counts), min(most, n)) for counts in found]


def _cells(plain: DataFrame, cuts: list[list[float]], *by: str) -> DataFrame:
    """Rows with equal bins as one: their mean label, their number, and the squares around the mean.

    Trees over bins split alike on these, since squares within a cell are the same on both sides of a gain.
    """
    binned = _binned(plain, _features(plain), cuts)
    names = [f"b_{c}" for c in _features(plain)]
    n = F.count(F.lit(1))
    # A missing label stays one, which Spark refuses.
    mean = F.when(F.count("y") == n, F.avg("y"))
    cells = binned.groupBy(*by, *names).agg(
        mean.alias("y"), n.cast("double").alias("n"), (F.var_pop("y") * n).alias("squares")
    )
    return cells.select(*by, "y", "n", "squares", _vector(names).alias("__bins"))


def _curve(trees: Any, cells: DataFrame) -> list[float]:
    """Mean squared error of the rows behind the cells after each round."""
    within = cells.agg((F.sum("squares") / F.sum("n")).alias("e")).first()["e"] or 0.0
    return [e + within for e in trees.evaluateEachIteration(cells, "squared")]


@dataclass
class Prepared:
    """Training rows as cells: those to fit and, if there are both, those set aside."""

    cuts: list[list[float]]
    fitted: DataFrame
    aside: DataFrame | None
    bins: int


# Cells that one task of a round works on.
CELLS_A_TASK = 50_000


def _prepared(plain: DataFrame, most_bins: int | None = None, ident: str = ID) -> Prepared:
    """Cells of equal bins, whose number depends on bins and features and not on rows."""
    sizes = {r["stop"]: r["count"] for r in plain.groupBy("stop").count().collect()}
    watched = bool(sizes.get(True)) and bool(sizes.get(False))
    # Rows of which it is unknown whether they stop take part only where nothing is set aside.
    plain = plain.where(F.col("stop").isNotNull()) if watched else plain.withColumn("stop", F.lit(False))
    n = sizes[False] if watched else sum(sizes.values())
    cuts = _all_borders(plain.where(~F.col("stop")), n, most_bins or GBTRegressor().getMaxBins(), ident)
    cells = _cells(plain, cuts, "stop").persist(StorageLevel.MEMORY_AND_DISK)
    # A round runs several small jobs, whose time is that of their tasks.
    count = cells.count()
    few = cells.coalesce(max(1, -(-count // CELLS_A_TASK))).persist(StorageLevel.MEMORY_AND_DISK)
    few.count()
    cells.unpersist()
    # Enough for Spark to look at every cell when it lists the bins.
    bins = max(2, math.isqrt(count) + 1, *[len(c) + 1 for c in cuts])
    return Prepared(cuts, few.where(~F.col("stop")), few.where("stop") if watched else None, bins)


def _boosted(ready: Prepared, params: dict[str, Any], patience: int = PATIENCE, cut: bool = False) -> Boosting:
    """Trees are added until ``patience`` rounds bring no gain on the rows marked ``stop``.

    Spark's trees cannot be continued, so the number of rounds is doubled from ``2 * patience`` until the
    curve decides or ``maxIter`` is reached: fewer than four times the rounds needed are fitted.
    Without rows set aside all rounds count. ``cut`` leaves the model with the rounds that count.
    """

    def fit(rounds: int) -> Any:
        some = {**params, "maxIter": rounds, "maxBins": ready.bins}
        return GBTRegressor(featuresCol="__bins", labelCol="y", weightCol="n", seed=SEED, **some).fit(ready.fitted)

    most = params.get("maxIter", GBTRegressor().getMaxIter())
    if ready.aside is None:
        return Boosting(BinnedTrees(fit(most), ready.cuts), [], most)
    rounds = min(most, 2 * patience)
    while True:
        trees = fit(rounds)
        curve = _curve(trees, ready.aside)
        kept, decided = kept_rounds(curve, patience)
        if decided or rounds == most:
            break
        rounds = min(most, 2 * rounds)
    if cut and kept < len(curve):
        trees = fit(kept)
    return Boosting(BinnedTrees(trees, ready.cuts), curve, kept)


def fit_boosted(train: DataFrame, params: dict[str, Any], patience: int = PATIENCE, ident: str = ID) -> Boosting:
    """The model cut to the rounds that count; the seed makes its trees the first ones of the longer fit."""
    return _boosted(_prepared(_plain(train, ident), params.get("maxBins"), ident), params, patience, cut=True)


def _grid_boosted(train: DataFrame, grid: dict[str, list], folds: int) -> tuple[DataFrame, Best]:
    combos = _combos(grid)
    plain = _plain(train, ID).persist(StorageLevel.MEMORY_AND_DISK)

    @inheritable_thread_target(train.sparkSession)
    def cells(task: tuple[int | None, int]) -> tuple[Prepared, DataFrame]:
        most, fold = task
        ready = _prepared(plain.where(F.col("fold") != fold), most)
        return ready, _cells(plain.where(F.col("fold") == fold), ready.cuts).coalesce(1).persist(StorageLevel.MEMORY_AND_DISK)

    @inheritable_thread_target(train.sparkSession)
    def error(task: tuple[dict[str, Any], int]) -> float:
        params, fold = task
        ready, held = folded[params.get("maxBins"), fold]
        found = _boosted(ready, params)
        # The error after each round is read off one pass, so trees beyond the kept ones do no harm.
        return _curve(found.model.trees, held)[found.rounds - 1]

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        tasks = list(product({p.get("maxBins"): None for p in combos}, range(folds)))
        folded = dict(zip(tasks, pool.map(cells, tasks)))
        errors = list(pool.map(error, product(combos, range(folds))))
    means = [sum(errors[i * folds : (i + 1) * folds]) / folds for i in range(len(combos))]
    out = _ranked(train, "gbt", combos, means, lambda p: _boosted(_prepared(plain, p.get("maxBins")), p, cut=True).model)
    plain.unpersist()
    return out


def boosting_curve(train: DataFrame, params: dict[str, Any], patience: int = PATIENCE) -> DataFrame:
    """Error of the rows set aside after each round that was fitted, and whether its tree is kept."""
    found = _boosted(_prepared(_plain(train, ID), params.get("maxBins")), params, patience)
    rows = [(i, float(e), i <= found.rounds) for i, e in enumerate(found.curve, 1)]
    return train.sparkSession.createDataFrame(rows, "round int, mse double, kept boolean")


# ---- linear models ------------------------------------------------------------------------------


@dataclass
class Moments:
    """Rows, means, centred sums of products and ranges of the features and the label, which comes last."""

    n: int
    mean: np.ndarray
    products: np.ndarray
    low: np.ndarray
    high: np.ndarray


@dataclass
class Linear:
    intercept: float
    weights: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array(F.col("x"))
        out: Column = F.lit(self.intercept)
        for i, w in enumerate(self.weights):
            out = out + x[i] * F.lit(w)
        return df.withColumn("prediction", out)


def fold_moments(train: DataFrame) -> dict[int, Moments]:
    """Moments by fold from one aggregate; what comes home depends on folds and features only.

    Rows whose label is null take no part. Covariances are merged from partial ones, which stays
    accurate where means are large.
    """
    width = _width(train)
    names = [f"v{i}" for i in range(width + 1)]
    wide = train.where(F.col("y").isNotNull()).withColumn("__x", vector_to_array("x")).select(
        "fold", *[F.col("__x")[i].alias(names[i]) for i in range(width)], F.col("y").alias(names[-1])
    )
    pairs = [(i, j) for i in range(width + 1) for j in range(i, width + 1)]
    found = wide.groupBy("fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(c) for c in names]).alias("mean"),
        F.array(*[F.covar_pop(names[i], names[j]) for i, j in pairs]).alias("covar"),
        F.array(*[F.min(c) for c in names]).alias("low"),
        F.array(*[F.max(c) for c in names]).alias("high"),
    )
    out = {}
    for row in found.collect():
        products = np.zeros((width + 1, width + 1))
        for (i, j), c in zip(pairs, row["covar"]):
            products[i, j] = products[j, i] = c * row["n"]
        vectors = [np.array(row[c]) for c in ("low", "high")]
        out[row["fold"]] = Moments(row["n"], np.array(row["mean"]), products, *vectors)
    return out


def merged(parts: list[Moments]) -> Moments:
    n = sum(p.n for p in parts)
    mean = sum(p.mean * (p.n / n) for p in parts)
    products = sum(p.products + p.n * np.outer(p.mean - mean, p.mean - mean) for p in parts)
    return Moments(n, mean, products, np.min([p.low for p in parts], axis=0), np.max([p.high for p in parts], axis=0))


# An elastic net is settled when no coefficient moves by more than this in a sweep.
SETTLED = 1e-12
SWEEPS = 10_000


def solve_linear(m: Moments, regParam: float = 0.0, elasticNetParam: float = 0.0) -> Linear:
    """Least squares with penalties on the coefficients of standardised features, from moments alone.

    Penalties mean what they mean in ``LinearRegression``. A constant feature gets 0; of dependent
    features without a penalty the shortest solution is taken.
    """
    # The range tells a constant column exactly; merged means leave it a trace of a deviation.
    deviation = np.where(m.high > m.low, np.sqrt(np.maximum(np.diag(m.products) / m.n, 0.0)), 0.0)
    spread, own = deviation[:-1], deviation[-1]
    weights = np.zeros(len(spread))
    use = np.nonzero(spread > 0)[0]
    if own > 0 and len(use):
        scale = spread[use]
        r = m.products[np.ix_(use, use)] / m.n / np.outer(scale, scale)
        c = m.products[use, -1] / m.n / scale / own
        first, second = regParam * elasticNetParam / own, regParam * (1 - elasticNetParam) / own
        gamma = np.linalg.lstsq(r + second * np.eye(len(use)), c, rcond=None)[0]
        for _ in range(SWEEPS if first > 0 else 0):
            before = gamma.copy()
            for j in range(len(use)):
                pull = c[j] - r[j] @ gamma + r[j, j] * gamma[j]
                gamma[j] = np.sign(pull) * max(abs(pull) - first, 0.0) / (r[j, j] + second)
            if np.abs(gamma - before).max() < SETTLED:
                break
        weights[use] = gamma * own / scale
    return Linear(float(m.mean[-1] - weights @ m.mean[:-1]), tuple(weights.tolist()))


def linear_error(model: Linear, m: Moments) -> float:
    """Mean squared error on the rows behind the moments."""
    direction = np.array([*model.weights, -1.0])
    bias = model.intercept + direction @ m.mean
    return float(direction @ m.products @ direction / m.n + bias * bias)


def _grid_linear(train: DataFrame, grid: dict[str, list], folds: int) -> tuple[DataFrame, Best]:
    """Every fold and penalty is solved from one aggregate of the training rows."""
    moments = fold_moments(train)
    combos = _combos(grid)
    errors = []
    for params in combos:
        held = [f for f in range(folds) if f in moments and len(moments) > 1]
        fits = [solve_linear(merged([m for g, m in moments.items() if g != f]), **params) for f in held]
        errors.append(sum(linear_error(fit, moments[f]) for fit, f in zip(fits, held)) / len(held))
    whole = merged(list(moments.values()))
    return _ranked(train, "glm", combos, errors, lambda p: solve_linear(whole, **p))


# ---- dense nets ---------------------------------------------------------------------------------


def _net_inputs(df: DataFrame, features: list[str], scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns(
        {f"__s_{f}": (F.col(f) - F.lit(scale[f][0])) / F.lit(scale[f][1]) for f in [*features, "y"]}
    )


@dataclass
class ScaledNet:
    """A regression net with the means and deviations its inputs and target are scaled by."""

    net: Net
    features: list[str]
    scale: dict[str, tuple[float, float]]

    def transform(self, df: DataFrame) -> DataFrame:
        ready = _net_inputs(df, self.features, self.scale)
        names = [f"__s_{f}" for f in self.features]
        out = with_output(ready, self.net, names, "__o").drop(*names, "__s_y")
        mean, deviation = self.scale["y"]
        return out.withColumn("prediction", F.col("__o") * deviation + mean).drop("__o")


def fit_scaled_net(train: DataFrame, features: list[str], widths: tuple[int, ...], epochs: int, ident: str = ID) -> ScaledNet:
    row = train.agg(
        *[F.avg(c).alias(f"m_{c}") for c in [*features, "y"]],
        *[F.stddev_pop(c).alias(f"d_{c}") for c in [*features, "y"]],
    ).first()
    scale = {c: (float(row[f"m_{c}"]), float(row[f"d_{c}"] or 1.0) or 1.0) for c in [*features, "y"]}
    net, _ = fit_net(
        _net_inputs(train, features, scale), regression_net(len(features), widths),
        [f"__s_{f}" for f in features], ["__s_y"], ident, epochs=epochs, seed=SEED, validation=0.0,
    )
    return ScaledNet(net, features, scale)


def fit_fold_nets(
    train: DataFrame, features: list[str], grid: list[tuple[int, ...]], epochs: int, folds: int = FOLDS, ident: str = ID
) -> dict[tuple[tuple[int, ...], int], ScaledNet]:
    """The net of every width and fold, as ``fit_scaled_net`` gives it for the rows outside the fold."""
    columns = [*features, "y"]
    others = {f: {c: F.when(F.col("fold") != f, F.col(c)) for c in columns} for f in range(folds)}
    row = train.agg(
        *[F.avg(v).alias(f"m_{f}_{c}") for f, own in others.items() for c, v in own.items()],
        *[F.stddev_pop(v).alias(f"d_{f}_{c}") for f, own in others.items() for c, v in own.items()],
    ).first()
    scales = [
        {c: (float(row[f"m_{f}_{c}"]), float(row[f"d_{f}_{c}"] or 1.0) or 1.0) for c in columns} for f in range(folds)
    ]
    tasks = list(product(grid, range(folds)))
    lessons = [Lesson(regression_net(len(features), widths), f, tuple(scales[f].values())) for widths, f in tasks]
    nets = fit_nets(train, lessons, columns, ident, epochs=epochs, seed=SEED)
    return {task: ScaledNet(net, features, scales[task[1]]) for task, net in zip(tasks, nets)}


def grid_dense(
    train: DataFrame, features: list[str], grid: list[tuple[int, ...]], epochs: int = 10, folds: int = FOLDS
) -> tuple[DataFrame, Best]:
    """The same search for dense nets, whose grid lists hidden widths."""
    models = fit_fold_nets(train, features, grid, epochs, folds)

    @inheritable_thread_target(train.sparkSession)
    def error(task: tuple[tuple[int, ...], int]) -> float:
        return mse(models[task].transform(train.where(F.col("fold") == task[1])))

    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        errors = list(pool.map(error, product(grid, range(folds))))
    rows = [
        ("dnn", str({"widths": widths}), float(sum(errors[i * folds : (i + 1) * folds]) / folds))
        for i, widths in enumerate(grid)
    ]
    table = train.sparkSession.createDataFrame(rows, "family string, params string, mse double")
    at = min(range(len(rows)), key=lambda i: (rows[i][2], i))
    best = fit_scaled_net(train, features, grid[at], epochs)
    return table.orderBy("mse"), Best("dnn", {"widths": grid[at], "epochs": epochs}, rows[at][2], best)


def mse(predicted: DataFrame, label: str = "y", prediction: str = "prediction") -> float:
    return predicted.select(((F.col(label) - F.col(prediction)) ** 2).alias("e")).agg(F.avg("e")).first()[0]


def leaderboard(bests: list[Best], test: DataFrame) -> DataFrame:
    """Held-out error of the best of each family, lowest first."""
    rows = [(b.family, str(b.params), b.cv_mse, float(mse(b.model.transform(test)))) for b in bests]
    table = test.sparkSession.createDataFrame(
        rows, "family string, params string, cv_mse double, mse double"
    )
    return table.orderBy("mse", "family")


def _refit(best: Best, train: DataFrame) -> Model | Linear | BinnedTrees:
    if best.family == "gbt":
        return fit_boosted(train, best.params).model
    if best.family == "glm":
        return solve_linear(merged(list(fold_moments(train).values())), **best.params)
    return RandomForestRegressor(featuresCol="x", labelCol="y", seed=SEED, **best.params).fit(train)


@dataclass
class Stack:
    """Base models and the linear model over their predictions."""

    bases: list[Best]
    meta: Any

    def transform(self, df: DataFrame) -> DataFrame:
        for best in self.bases:
            df = best.model.transform(df).withColumnRenamed("prediction", f"p_{best.family}")
        return self.meta.transform(_meta_inputs(df, self.bases)).drop("meta_x")


def _meta_inputs(df: DataFrame, bases: list[Best]) -> DataFrame:
    names = [f"p_{b.family}" for b in bases]
    return VectorAssembler(inputCols=names, outputCol="meta_x").transform(df)


def stacked_ensemble(
    bases: list[Best], train: DataFrame, features: list[str], folds: int = FOLDS
) -> Stack:
    """Linear model over out-of-fold predictions of the base models."""

    @inheritable_thread_target(train.sparkSession)
    def refit(task: tuple[int, Best]) -> Model | Linear | BinnedTrees:
        fold, best = task
        return _refit(best, train.where(F.col("fold") != fold))

    tasks = list(product(range(folds), bases))
    nets = {
        b.family: fit_fold_nets(train, features, [b.params["widths"]], b.params["epochs"], folds)
        for b in bases if b.family == "dnn"
    }
    with ThreadPoolExecutor(PARALLEL_FITS) as pool:
        others = pool.map(refit, [t for t in tasks if t[1].family not in nets])
        models = [
            nets[best.family][best.params["widths"], fold] if best.family in nets else next(others) for fold, best in tasks
        ]
    parts = None
    for fold in range(folds):
        held = train.where(F.col("fold") == fold)
        for best, model in zip(bases, models[fold * len(bases) :]):
            held = model.transform(held).withColumnRenamed("prediction", f"p_{best.family}")
        held = held.select("y", *[f"p_{b.family}" for b in bases])
        parts = held if parts is None else parts.unionByName(held)
    meta = LinearRegression(featuresCol="meta_x", labelCol="y").fit(_meta_inputs(parts, bases))
    return Stack(bases, meta)
