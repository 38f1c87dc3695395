"""Hard negatives against all pairs in plain Python."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlot.llm import hard_negatives as module
from oddlot.llm.hard_negatives import Walk, _Best, hard_negatives, spanning_trees


def expected(rows, top=5):
    """``rows`` are (id, label, vector) that take part, one per id."""
    whole = {i: (g, [math.floor(256 * x) for x in v]) for i, g, v in rows}
    out = []
    for a, (label, q) in whole.items():
        if a % 100:
            continue
        scores = [(-sum(x * y for x, y in zip(q, r)), i, g) for i, (g, r) in whole.items() if i != a and len(r) == len(q)]
        positives = sorted((s, i) for s, i, g in scores if g == label)[:top]
        for less, p in positives:
            fits = sorted((s, i) for s, i, g in scores if g != label and 80 * -less <= 100 * -s <= 100 * -less)[:top]
            out += [(a, p, r, i, -less, -s) for r, (s, i) in enumerate(fits, 1)]
    return sorted(out)


def drawn(seed, n, size=12, labels=3, spread=0.3):
    draw = np.random.default_rng(seed)
    centers = draw.standard_normal((labels, size))
    out = []
    for i in range(n):
        x = centers[i % labels] + spread * draw.standard_normal(size)
        out.append((i, int((i + (i % 7 == 0)) % labels), (x / np.linalg.norm(x)).tolist()))
    return out


SCHEMA = "vec_id long, label int, embedding array<double>"


def mined(spark, rows, **more):
    found = hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("vec_id") % 100 == 0, **more)
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("stripe, block, group", [(8192, 512, 16), (50, 512, 1), (70, 3, 2)])
def test_equals_all_pairs(spark, monkeypatch, stripe, block, group):
    for name, value in (("STRIPE", stripe), ("BLOCK", block), ("STRIPES_A_TASK", group)):
        monkeypatch.setattr(module, name, value)
    rows = drawn(1, 900)
    rows = [(i * 10, g, v) for i, g, v in rows]
    assert mined(spark, rows) == expected(rows)


def test_awkward_rows(spark):
    rows = [(i * 10, g, v) for i, g, v in drawn(2, 120)]
    ties = [(5000 + i, i % 2, rows[0][2]) for i in range(40)] + [(5100, 0, [0.0] * 12), (5200, 1, [-x for x in rows[0][2]])]
    other = [(6000 + i, i % 3, [0.5 * i, 1.0]) for i in range(7)]
    odd = [(None, 1, rows[0][2]), (7001, None, rows[0][2]), (7002, 1, None), (7003, 1, []), (7004, 1, [None] * 12), (7005, 1, [float("nan")] * 12), (7006, 1, [float("inf")] * 12)]
    twice = [rows[3], rows[3], (rows[4][0], rows[4][1] + 1, rows[4][2])]
    assert mined(spark, rows + ties + other + odd + twice) == expected(rows + ties + other)


def test_scores_too_large_for_doubles(spark):
    rows = [(i * 25, i % 2, [float(3e5 * (i + 1)), 7.0 + i / 3, -2e5 * i]) for i in range(20)]
    assert mined(spark, rows) == expected(rows)
    huge = [(i * 25, i % 2, [1e30 + i, 1.0]) for i in range(12)]
    assert len(mined(spark, huge)) > 0


def test_small_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, 1, [1.0])]) == [] and mined(spark, [(100, 1, [1.0])]) == []
    assert mined(spark, [(100, 1, [1.0]), (1, 1, [1.0]), (2, 2, [0.9])]) == [(100, 1, 1, 2, 65536, 256 * 230)]
    extra = spark.createDataFrame([(100, 1, [1.0], 3, 4, "x"), (1, 1, [1.0], 3, 4, "x"), (2, 2, [0.9], 3, 4, "x")], f"{SCHEMA}, size int, stripe int, window string")
    assert hard_negatives(extra, F.col("vec_id") % 100 == 0).count() == 1


def test_trees_span_each_label_with_shortest_edges():
    draw = np.random.default_rng(5)
    x, labels = draw.standard_normal((60, 4)), draw.integers(0, 3, 60)
    order, parents, edges = spanning_trees(labels, x)
    seen = set()
    for at in order:
        assert parents[at] == at or parents[at] in seen
        assert labels[parents[at]] == labels[at]
        assert edges[at] == pytest.approx(np.linalg.norm(x[at] - x[parents[at]]))
        seen.add(at)
    assert len(seen) == 60 and (parents == np.arange(60)).sum() == 3
    for label in range(3):  # Kruskal
        own = np.flatnonzero(labels == label)
        group = {i: i for i in own}
        total = 0.0
        for d, i, j in sorted((np.linalg.norm(x[i] - x[j]), i, j) for i in own for j in own if i < j):
            if group[i] != group[j]:
                total += d
                old = group[j]
                group = {k: group[i] if g == old else g for k, g in group.items()}
        assert edges[own].sum() == pytest.approx(total)


def test_bounds_spare_most_scores():
    """Anchors in tight clusters rescore few candidates."""
    draw = np.random.default_rng(6)
    centers = draw.standard_normal((20, 16))
    vectors = np.floor(256 * (centers[np.arange(2000) % 20] + 0.02 * draw.standard_normal((2000, 16))))
    labels = np.arange(2000) % 20 % 4
    ids = np.arange(2000)
    anchors = np.arange(0, 2000, 25)
    order, parents, edges = spanning_trees(labels[anchors], vectors[anchors])
    place = np.argsort(order)
    at = anchors[order]
    walk = Walk(ids[at], labels[at], vectors[at], place[parents[order]], edges[order], True, [[_Best(-math.inf, math.inf, 5, [])] for _ in at])
    for i in range(0, 2000, 500):
        walk.meet(ids[i : i + 500], labels[i : i + 500], vectors[i : i + 500])
    assert walk.rescored < 0.5 * sum((labels == g).sum() for g in labels[at])
    for a, (w,) in zip(at, walk.windows):
        own = [(-int(vectors[a] @ vectors[i]), int(i)) for i in ids if i != a and labels[i] == labels[a]]
        assert w.rows == sorted(own)[:5]
