"""The state of pairs against plain Python, how much of it is shuffled, and how often it is built."""

import math
import random

import pyarrow as pa
import pytest

from oddlot.columns import AMOUNT, CUSTOMER, ID, MERCHANT
from oddlot.operators import pair_state as ps
from oddlot.plans import feature_run

SCHEMA = f"{CUSTOMER} string, {MERCHANT} int, {ID} long, {AMOUNT} double"


def some_rows(n, seed=3):
    """A third of all rows in one pair; ties, null keys, ids and amounts, infinities and NaN."""
    draw = random.Random(seed)
    amounts = [None, math.nan, math.inf, -math.inf, 0.0, 1.5, 1.5, 2.0, -3.0]
    rows = []
    for i in range(n):
        pair = ("hot", 1) if draw.random() < 0.34 else (draw.choice(["a", "b", "", None]), draw.choice([1, 2, 3, None]))
        amount = draw.choice(amounts) if draw.random() < 0.5 else round(draw.uniform(-9, 9), 2)
        rows.append((*pair, i if draw.random() < 0.97 else None, amount))
    return rows


def size(amount):
    """Null below all numbers, NaN above them."""
    return (0, 0.0) if amount is None else (2, 0.0) if math.isnan(amount) else (1, amount)


def plain_states(rows):
    pairs = {}
    for customer, merchant, ident, amount in rows:
        pairs.setdefault((customer, merchant), []).append((ident, amount))
    out = {}
    for pair, found in pairs.items():
        late = [(i if i is not None else math.inf, a, i) for i, a in found]
        least = sorted(late, key=lambda r: (size(r[1]), r[0]))
        most = sorted(late, key=lambda r: (tuple(-x for x in size(r[1])), r[0]))
        values = lambda side: [side[k][1] if k < len(side) else None for k in range(3)]
        out[pair] = (
            sum(i is not None for i, _ in found), most[0][2], least[0][2], *map(repr, values(most) + values(least))
        )
    return out


def spark_states(df):
    out = {}
    for r in ps.pair_state(df).collect():
        values = [r[f"__{side}{k}"] for side in ("most", "least") for k in (1, 2, 3)]
        key = (r[CUSTOMER], r[MERCHANT])
        assert key not in out
        out[key] = (r["frequency"], r["__most_id"], r["__least_id"], *map(repr, values))
    return out


@pytest.mark.parametrize("held", [5, 64, 200_000])
def test_states_equal_plain_python(spark, monkeypatch, held):
    rows = some_rows(1200)
    monkeypatch.setattr(ps, "HELD", held)
    monkeypatch.setattr(ps, "_before_shuffle", by_value(ps._before_shuffle, HELD=held))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        assert spark_states(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain_states(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def by_value(function, **values):
    """The function with other module values, which workers would read from their own import."""
    module = function.__module__

    def run(batches):
        import importlib

        home = importlib.import_module(module)
        for name, value in values.items():
            setattr(home, name, value)
        yield from function(batches)

    return run


def test_no_rows_no_states(spark):
    assert ps.pair_state(spark.createDataFrame([], SCHEMA)).collect() == []


def test_a_hot_pair_leaves_a_task_with_six_rows():
    n = 50_000
    table = pa.table(
        {
            CUSTOMER: ["hot"] * n, MERCHANT: pa.array([1] * n, pa.int32()), ID: list(range(n)),
            AMOUNT: [float(i * 7919 % n) for i in range(n)], "__n": [1] * n,
        }
    )
    out = pa.Table.from_batches(ps._before_shuffle(iter(table.to_batches(max_chunksize=1000))))
    assert out.num_rows == 6
    assert sum(out["__n"].to_pylist()) == n
    assert sorted(out[AMOUNT].to_pylist()) == [0.0, 1.0, 2.0, n - 3.0, n - 2.0, n - 1.0]


def test_rows_are_reduced_before_the_only_shuffle(spark):
    df = spark.createDataFrame(some_rows(50), SCHEMA)
    plan = ps.pair_state(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.index("Exchange") < plan.rindex("MapInArrow")


def test_pairs_are_counted_once_between_steps_that_drop_rows(spark, small_events, monkeypatch):
    built = []
    monkeypatch.setattr(feature_run.ps, "pair_state", lambda df, of=ps.pair_state: built.append(1) or of(df))
    feature_run.run_features(small_events, "all")
    assert len(built) == 2
    assert feature_run.stretches(feature_run.resolve("all")) == [
        ["c_m_ratios", "c_freq_diff"], [ps.PEAK_SCORE, "slope", "gmm"],
    ]


def test_slopes_with_missing_amounts(spark):
    rows = [("a", 1, 1, 9.0), ("a", 1, 2, 4.0), ("a", 1, 3, None), ("b", 1, 4, 5.0), ("c", 1, 5, 1.0), ("c", 1, 6, 1.0)]
    state = ps.with_pair_scores(ps.pair_state(spark.createDataFrame(rows, SCHEMA)), ps.slope_scores())
    found = {r[CUSTOMER]: r["__most_slope"] for r in state.collect()}
    assert found == {"a": 1.0, "b": None, "c": 0.0}
