"""Merchant segments and labelled anomaly injection into an existing transaction table."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, CUSTOMER, ID, MERCHANT, RAW_TIME
from oddlot.functions.scalars import md5_rank, md5_unit
from oddlot.operators.ranking import with_row_index
from oddlot.operators.skew import HotKeys, profile, with_previous_time
from oddlot.session import settle

# Share of the merchants each segment takes; the last takes what is left.
SEGMENTS = (
    ("segment_1", 0.2),
    ("segment_2", 0.35),
    ("segment_3", 0.25),
    ("segment_4", 0.15),
    ("segment_5", 0.5),
)
# Fixed value: anomalous and ordinary draws in the urn.
ANOMALY_SHARE = 2000 / (2000 + 10000)


def merchant_segments(
    transactions: DataFrame, segments: tuple[tuple[str, float], ...] = SEGMENTS, seed: int = 0
) -> DataFrame:
    """Assign every merchant to one segment; membership is drawn by hash."""
    merchants = settle(transactions.select(MERCHANT).distinct())
    count = merchants.count()
    merchants = merchants.withColumn("__h", md5_rank(F.col(MERCHANT), seed))
    ranked = with_row_index(merchants, ["__h", MERCHANT], "__r")
    taken, choice = 0, None
    for name, ratio in segments[:-1]:
        taken += int(ratio * count)
        test = F.col("__r") < taken
        choice = F.when(test, F.lit(name)) if choice is None else choice.when(test, F.lit(name))
    return ranked.select(MERCHANT, choice.otherwise(F.lit(segments[-1][0])).alias("segment"))


def inject_anomalies(
    df: DataFrame,
    segments: DataFrame,
    share: float = ANOMALY_SHARE,
    seed: int = 11,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Turn a share of the rows into labelled anomalies (``is_injected``).

    Each customer belongs to two segments. An anomalous row moves to a merchant outside both, one
    second after the previous transaction of its pair, with the amount times 1000 or set to 0.1.
    """
    hot = profile(df, hot)
    # Position of the merchant when the segments are laid end to end.
    segments = settle(segments)
    places = with_row_index(segments, ["segment", MERCHANT], "__place")
    counted = segments.groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()
    sizes = {r["segment"]: r["n"] for r in counted}
    names = sorted(sizes)
    n = len(names)
    if n < 3:
        raise ValueError("three segments are needed to leave one outside a customer's two")
    starts, at = [], 0
    for name in names:
        starts.append(at)
        at += sizes[name]
    total = at
    size_of = F.array(*[F.lit(sizes[s]) for s in names])
    start_of = F.array(*[F.lit(s) for s in starts])

    first = F.floor(md5_unit(F.col(CUSTOMER), seed + 3) * n).cast("int")
    second = F.pmod(first + 1 + F.floor(md5_unit(F.col(CUSTOMER), seed + 4) * (n - 1)), F.lit(n)).cast("int")
    df = with_previous_time(df, [CUSTOMER, MERCHANT], RAW_TIME, ID, "__prev", hot)
    df = df.withColumn("__hit", md5_unit(F.col(ID), seed) < share)
    df = df.withColumn("__low", F.least(first, second)).withColumn("__high", F.greatest(first, second))

    def at_index(values, index):
        return F.element_at(values, index + 1)

    outside = F.lit(total) - at_index(size_of, F.col("__low")) - at_index(size_of, F.col("__high"))
    want = F.floor(md5_unit(F.col(ID), seed + 1) * outside)
    # Skip the customer's own segments, lower one first.
    want = want + F.when(want >= at_index(start_of, F.col("__low")), at_index(size_of, F.col("__low"))).otherwise(0)
    want = want + F.when(want >= at_index(start_of, F.col("__high")), at_index(size_of, F.col("__high"))).otherwise(0)
    # Rows that stay where they are have no place; each gets a number below zero of its own.
    nowhere = -1 - F.pmod(F.xxhash64(F.col(ID)), F.lit(2**40))
    df = df.withColumn("__place", F.when(F.col("__hit"), want).otherwise(nowhere))
    places = places.select("__place", F.col(MERCHANT).alias("__new"))
    # Merchants are spread evenly over places, so this join has no hot key of its own.
    moved = df.join(places, "__place", "left")
    amount = F.when(md5_unit(F.col(ID), seed + 2) < 0.5, F.col(AMOUNT) * 1000).otherwise(F.lit(0.1))
    one_second = F.expr("INTERVAL '1' SECOND")
    hit = F.col("__hit")
    return moved.withColumns(
        {
            MERCHANT: F.when(hit, F.col("__new")).otherwise(F.col(MERCHANT)),
            RAW_TIME: F.when(hit, F.coalesce("__prev", RAW_TIME) + one_second).otherwise(F.col(RAW_TIME)),
            AMOUNT: F.when(hit, amount).otherwise(F.col(AMOUNT)),
            "is_injected": hit.cast("int"),
        }
    ).drop("__place", "__new", "__prev", "__hit", "__low", "__high")
