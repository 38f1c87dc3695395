"""One small state per pair: number of transactions, three largest and three smallest amounts.

The state is combined before the shuffle. Each task reduces its rows to at most six per pair and
``HELD`` rows read, every kept row carrying the count of those it stands for, so a hot pair sends a few
rows per task however many it has. After one exchange by pair the same reduction runs over the sorted
rows, a pair at a time. Noise removal, the pair count, peaks, drops and slopes all read this state.

Nulls: null keys form pairs of their own; rows without an id do not count, as in ``count(id)``; null
amounts rank below all numbers and NaN above them. Ties go to the smallest id. An empty table has an
empty state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, ID, PAIR
from oddlot.functions.scalars import min_max
from oddlot.operators.skew import HotKeys, join_hot_aware, profile

EXTREMES = 3
HELD = 200_000
FREQUENCY = "frequency"
PEAK_SCORE = "c_m_peak_drop_min_max_p_value"
SECOND_EXTREMES = ("amount_max", "amount_max_2nd", "amount_min", "amount_min_2nd")
PEAK_COLUMNS = (*SECOND_EXTREMES, PEAK_SCORE, "drop_score")
SLOPE_COLUMNS = ("__most_id", "__most_slope", "__least_id", "__least_slope")


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, int]:
    """Dense numbers of the values, null being a value, and how many there are."""
    plain = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    coded = plain.dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)


class _Order:
    """Rows of a table grouped by pair, ascending and descending by (amount, id)."""

    def __init__(self, table: pa.Table) -> None:
        left, _ = _codes(table[PAIR[0]])
        right, many = _codes(table[PAIR[1]])
        self.pair = left * many + right
        # Ranks order any type of id; null ids come last.
        ident = pc.rank(table[ID], sort_keys="ascending", null_placement="at_end", tiebreaker="dense")
        ident = ident.to_numpy(zero_copy_only=False).astype(np.int64)
        known = table[AMOUNT].is_valid().to_numpy(zero_copy_only=False)
        amount = pc.fill_null(table[AMOUNT], 0.0).to_numpy(zero_copy_only=False)
        nan = np.isnan(amount)
        kind = np.where(nan, 2, known.astype(int))
        amount = np.where(nan, 0.0, amount)
        self.up = np.lexsort((ident, amount, kind, self.pair))
        self.down = np.lexsort((ident, -amount, -kind, self.pair))
        sorted_pair = self.pair[self.up]
        self.starts = np.flatnonzero(np.r_[True, sorted_pair[1:] != sorted_pair[:-1]])
        self.sizes = np.diff(np.r_[self.starts, len(sorted_pair)])
        # Both orders group rows alike, so a position within the group serves both.
        self.position = np.arange(len(sorted_pair)) - np.repeat(self.starts, self.sizes)


def _reduced(table: pa.Table) -> pa.Table:
    """The rows that can still be among a pair's extremes; the pair's count sits on its first row."""
    if table.num_rows == 0:
        return table
    order = _Order(table)
    first = order.position < EXTREMES
    kept = np.zeros(table.num_rows, dtype=bool)
    kept[order.up[first]] = True
    kept[order.down[first]] = True
    stands_for = table["__n"].to_numpy()
    counts = np.zeros(table.num_rows, dtype=np.int64)
    counts[order.up[order.starts]] = np.add.reduceat(stands_for[order.up], order.starts)
    at = table.schema.get_field_index("__n")
    table = table.set_column(at, table.schema.field(at), pa.array(counts))
    return table.filter(pa.array(kept))


def _before_shuffle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= HELD:
            state = _reduced(pa.Table.from_batches(held))
            # A state that hardly shrinks is passed on, so memory stays bounded by HELD rows.
            if state.num_rows > HELD // 2:
                yield from state.to_batches()
                held, rows = [], 0
            else:
                held, rows = state.to_batches(), state.num_rows
    if held:
        yield from _reduced(pa.Table.from_batches(held)).to_batches()


def _states(table: pa.Table) -> pa.Table:
    """One row per pair from all of its rows."""
    order = _Order(table)
    total = np.add.reduceat(table["__n"].to_numpy()[order.up], order.starts)
    firsts = pa.array(order.up[order.starts])
    out = {k: table[k].take(firsts) for k in PAIR}
    out[FREQUENCY] = pa.array(total)
    for side, rows in (("most", order.down), ("least", order.up)):
        for rank in range(EXTREMES):
            there = order.sizes > rank
            at = rows[np.minimum(order.starts + rank, len(rows) - 1)]
            picked = pa.array(at, mask=~there)
            out[f"__{side}{rank + 1}"] = table[AMOUNT].take(picked)
            if rank == 0:
                out[f"__{side}_id"] = table[ID].take(picked)
    return pa.table(out)


def _after_shuffle(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``batches`` are sorted by pair; only the last pair read may go on in the next batch."""
    held: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if table.num_rows == 0:
            continue
        held = table if held is None else pa.concat_tables([held, table])
        codes = _Order(held).pair
        going_on = codes == codes[-1]
        if not going_on.all():
            yield from _states(held.filter(pa.array(~going_on))).to_batches()
        held = _reduced(held.filter(pa.array(going_on)))
    if held is not None:
        yield from _states(held).to_batches()


def pair_state(df: DataFrame) -> DataFrame:
    """One row per pair: ``frequency``, ``__most1..3``, ``__least1..3`` and the ids of the two extremes."""
    source = df.select(
        *PAIR, ID, F.col(AMOUNT).cast("double").alias(AMOUNT), F.col(ID).isNotNull().cast("long").alias("__n")
    )
    keys = [f"`{k}` {source.schema[k].dataType.simpleString()}" for k in PAIR]
    ident = source.schema[ID].dataType.simpleString()
    sides = [
        f"{c} {ident if c.endswith('id') else 'double'}"
        for side in ("most", "least")
        for c in (f"__{side}1", f"__{side}_id", f"__{side}2", f"__{side}3")
    ]
    reduced = source.mapInArrow(_before_shuffle, source.schema)
    placed = reduced.repartition(*PAIR).sortWithinPartitions(*PAIR)
    return placed.mapInArrow(_after_shuffle, ", ".join([*keys, f"{FREQUENCY} bigint", *sides]))


def enough(state: DataFrame, min_transactions: int) -> Column:
    """Whether a pair has enough transactions; true for all if none has. ``state`` is read once more."""
    most = state.agg(F.coalesce(F.max(FREQUENCY) >= min_transactions, F.lit(False)).alias("x")).scalar()
    return (F.col(FREQUENCY) >= min_transactions) | ~most


def with_second_extremes(state: DataFrame) -> DataFrame:
    values = ("__most1", "__most2", "__least1", "__least2")
    return state.withColumns({n: F.col(v) for n, v in zip(SECOND_EXTREMES, values)})


def peak_scores() -> dict[str, Column]:
    """What ``with_pair_scores`` scales to the peak and drop scores."""
    peak, drop = F.col("__most1") - F.col("__most2"), F.col("__least2") - F.col("__least1")
    return {PEAK_SCORE: F.when(peak != 0, peak), "drop_score": F.when(drop != 0, drop)}


def slope_scores() -> dict[str, Column]:
    """What ``with_pair_scores`` scales to slopes: the regression slope of three amounts at ranks 1, 2 and 3.

    Of three equally spaced points it is half of last minus first, of two their difference.
    """
    out = {}
    for side in ("most", "least"):
        first, second, third = (F.col(f"__{side}{rank}") for rank in (1, 2, 3))
        out[f"__{side}_slope"] = F.abs(F.coalesce((third - first) / 2, second - first, third - second))
    return out


def with_pair_scores(state: DataFrame, *kinds: dict[str, Column]) -> DataFrame:
    """The second extremes and the given scores, each scaled over all pairs of the state.

    All ranges come from one aggregate, so they do not nest in each other's plans.
    """
    values = {name: value for kind in kinds for name, value in kind.items()}
    state = with_second_extremes(state).withColumns(values)
    ends = [e(name).alias(f"{e.__name__}_{i}") for i, name in enumerate(values) for e in (F.min, F.max)]
    ranges = state.agg(F.struct(*ends).alias("ranges")).scalar()
    return state.withColumns(
        {name: min_max(F.col(name), ranges[f"min_{i}"], ranges[f"max_{i}"]) for i, name in enumerate(values)}
    )


def attach_pairs(
    df: DataFrame, state: DataFrame, columns: Iterable[str], hot: HotKeys | None = None, drop: bool = False
) -> DataFrame:
    """Columns of the state on every row of the pair; ``drop`` leaves out rows of pairs not in it."""
    columns = list(columns)
    # Counts are never null, so their absence marks a missing pair.
    state = state.select(*PAIR, *columns, F.col(FREQUENCY).alias("__present"))
    joined = join_hot_aware(df.drop(*columns), state, PAIR, profile(df, hot))
    if drop:
        joined = joined.where(F.col("__present").isNotNull())
    return joined.drop("__present")
