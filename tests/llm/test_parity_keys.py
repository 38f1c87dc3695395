"""Block keys, sketches and what the n-gram join hands on to exact comparison."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from oddlot.llm import parity_join
from oddlot.llm.parity_join import _far, _sketch, _width, block_keys, jaccard_components
from oddlot.llm.tokens import mix


def pair(seed, n, percent):
    """Two random sets whose similarity is just ``percent``/100 or more."""
    draw = np.random.default_rng(seed)
    items = mix(draw.integers(0, 2**63, 2 * n).astype(np.uint64))
    apart = 0
    while True:
        more = apart + 1
        a, b = items[: n - more // 2], np.concatenate((items[: n - more], items[n : n + (more + 1) // 2 - more // 2]))
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(np.union1d(a, b))) or more >= n:
            break
        apart = more
    return np.unique(items[: n - apart // 2]), np.unique(np.concatenate((items[: n - apart], items[n : n + (apart + 1) // 2 - apart // 2])))


@pytest.mark.parametrize("percent", [80, 85])
@pytest.mark.parametrize("n", [1, 3, 9, 40, 80, 200, 700, 3000])
def test_near_sets_share_more_than_r_keys(n, percent):
    for seed in range(12):
        a, b = pair(seed, n, percent)
        if 100 * len(np.intersect1d(a, b)) < percent * len(np.union1d(a, b)):
            continue
        shared = np.intersect1d(block_keys(a, percent), block_keys(b, percent))
        by_group = [shared[(shared & np.uint64(1)) == g] for g in (0, 1)]
        assert any(len(keys) > int(keys[0] >> np.uint64(1) & np.uint64(7)) for keys in by_group if len(keys))
        total = len(a) + len(b)
        assert not _far(_sketch(a, _width(len(a))), _sketch(b, _width(len(b))), total, percent)


def test_wide_sketches_rule_out_unrelated_sets_of_any_size():
    draw = np.random.default_rng(1)
    for n in (300, 1_100, 5_000, 40_000):
        a, b = (np.unique(mix(draw.integers(0, 2**63, n + i * n // 9).astype(np.uint64))) for i in (0, 1))
        assert _far(_sketch(a, _width(len(a))), _sketch(b, _width(len(b))), len(a) + len(b), 80)


def test_folds_of_a_sketch_are_the_narrower_sketch():
    found = np.unique(mix(np.arange(1, 900, dtype=np.uint64)))
    wide = np.frombuffer(_sketch(found, 1024), dtype=np.uint8)
    assert (wide[:64] ^ wide[64:]).tobytes() == _sketch(found, 512)


def test_common_passages_bring_no_sets_to_comparison(spark, monkeypatch):
    """Documents that share a passage, and nothing else, are kept apart by keys and sketches."""
    passage = " ".join(f"p{i}" for i in range(30))
    texts = [" ".join([*(f"d{i}w{j}" for j in range(200 + i % 40)), passage]) for i in range(300)]
    near = [texts[0] + " tail", texts[7] + " tail more", texts[299] + " end"]
    df = spark.createDataFrame(list(enumerate(texts + near)), "doc_id long, text string").repartition(4)
    asked = []
    ship = parity_join._sets_of

    def counted(ids, rows, k):
        asked.append(ids.distinct().count())
        return ship(ids, rows, k)

    monkeypatch.setattr(parity_join, "_sets_of", counted)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_components(df).collect()}
    assert {d: c for d, c in got.items() if d != c} == {300: 0, 301: 7, 302: 299}
    assert sum(asked) <= 12


def test_tiles_spread_over_tasks(spark):
    rows = spark.range(40).select((F.col("id") % 1).alias("key"), F.col("id").alias("doc_id"))
    tiles = parity_join._tiles(rows, F.lit(1), 4, 19)
    plan = tiles.groupBy("key", "low", "high").count()._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"hashpartitioning\(key#\w+, low#\w+, high#\w+, .*REPARTITION_BY_COL", plan)
    for low, high in {(r["low"], r["high"]) for r in tiles.collect()}:
        assert low <= high
    pairs = {frozenset((a, b)) for t in tiles.groupBy("low", "high").agg(F.collect_list("doc_id").alias("d")).collect() for a in t["d"] for b in t["d"]}
    assert len(pairs) == 40 * 41 // 2
