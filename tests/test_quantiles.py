"""Radix selection of order statistics against numpy."""

import numpy as np
import pytest

from oddlot.operators import quantiles

PROBS = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.999, "e": 1.0}


def columns(rng, n):
    """Values that are far apart in size, tied, negative, tiny or all equal."""
    wide = rng.choice([-1, 1], n) * 10.0 ** rng.uniform(-300, 300, n)
    return {"wide": wide, "tied": rng.integers(0, 3, n).astype(float), "near": 1e9 + rng.uniform(0, 1e-6, n), "same": np.full(n, 7.5), "tiny": rng.integers(0, 9, n) * 5e-324}


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_whole_columns(spark, monkeypatch, broadcast_rows):
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 3)
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", broadcast_rows)
    data = columns(np.random.default_rng(1), 501)
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())], ", ".join(f"{c} double" for c in data))
    targets = {f"{c}_{p}": (c, q) for c in data for p, q in PROBS.items()}
    got = quantiles._large_quantiles(df, [], targets).first()
    for c, x in data.items():
        for p, q in PROBS.items():
            assert got[f"{c}_{p}"] == pytest.approx(np.quantile(x, q), rel=1e-12, abs=0), (c, p)
    assert quantiles.kth_smallest(df, "wide", 250, 501) == np.sort(data["wide"])[250]


@pytest.mark.parametrize("broadcast_rows", [10**6, 100])
def test_very_many_hot_groups(spark, monkeypatch, broadcast_rows):
    """10,000 groups, all in the state table, some without any value; null keys are a group."""
    monkeypatch.setattr(quantiles, "FINISH_ROWS", 2)
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", broadcast_rows)
    rng = np.random.default_rng(2)
    rows = [(int(g) if g else None, float(v) if v < 900 else None) for g, v in zip(rng.permutation(np.arange(50_000) % 10_000), rng.integers(0, 1000, 50_000))]
    rows += [(10_000, None)]
    df = spark.createDataFrame(rows, "g long, v double")
    got = {r["g"]: (r["m"], r["q"]) for r in quantiles._large_quantiles(df, ["g"], {"m": ("v", 0.5), "q": ("v", 0.9)}).collect()}
    groups = {}
    for g, v in rows:
        groups.setdefault(g, []).extend([] if v is None else [v])
    assert set(got) == set(groups)
    for g, x in groups.items():
        want = (np.quantile(x, 0.5), np.quantile(x, 0.9)) if x else (None, None)
        assert got[g] == (pytest.approx(want[0]), pytest.approx(want[1])) if x else got[g] == want


def test_values_without_an_order_of_size(spark):
    """Infinities and NaN sort as in SQL: NaN last."""
    x = [float("-inf"), -1.0, 0.0, 2.0, float("inf"), float("nan")]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    assert [quantiles.kth_smallest(df, "v", k, 6) for k in range(5)] == x[:5]
    assert np.isnan(quantiles.kth_smallest(df, "v", 5, 6))
