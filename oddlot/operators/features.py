"""Per-transaction anomaly features.

Each function takes a prepared transaction frame and returns it with columns added. ``hot`` is an
optional hot-key profile of the frame (or of a frame it was filtered from), so that a run over
many features counts keys only once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, CUSTOMER, HOUR, ID, MERCHANT, PAIR, PAIR_TEXT, TIME
from oddlot.functions.scalars import (
    SECONDS_PER_DAY, day_part, hours_between, row_total, text_key,
)
from oddlot.operators.pair_state import (
    PEAK_COLUMNS, PEAK_SCORE, SECOND_EXTREMES, SLOPE_COLUMNS, attach_pairs, pair_state, peak_scores, slope_scores,
    with_pair_scores, with_second_extremes,
)
from oddlot.operators.quantiles import group_quantiles
from oddlot.operators.ranking import with_row_index
from oddlot.operators.rfm import hours_until_reference
from oddlot.operators.skew import (
    HotKeys, in_parts, join_hot_aware, join_same, profile, with_group_facts, with_previous_time,
    with_trailing_sum,
)
from oddlot.operators.stats import normalised, normalised_name
from oddlot.session import settle

# Labels that are broadcast at most; a row of them has a handful of numbers.
FEW_LABELS = 500_000


def merchant_ratio(
    df: DataFrame, labels: DataFrame, feature: str = "c_m_ratios", hot: HotKeys | None = None,
    pair_count: str | None = None,
) -> DataFrame:
    """Share of the pair in the customer's transactions with merchants of the same label.

    ``labels`` has one row per merchant (``merchant_id``, ``merchant_label``, further columns are
    kept). Merchants without a label score 0. ``pair_count`` names a column that already holds the
    pair's number of transactions.

    Rows are shuffled once, by customer, which serves both counts, unless a customer is hot. Up to
    ``FEW_LABELS`` labels come to the rows by broadcast, more by a shuffle by merchant.
    """
    hot = profile(df, hot)
    df = df.drop(*[c for c in labels.columns if c != MERCHANT])
    # Counted and joined, so written once: one row per merchant.
    labels = settle(labels)
    if labels.count() <= FEW_LABELS:
        df = join_same(df, F.broadcast(labels), (MERCHANT,))
    else:
        df = join_hot_aware(df, labels, (MERCHANT,), hot)
    if hot.of(df, [CUSTOMER]) is None:
        df = df.repartition(CUSTOMER)
    labelled = F.col("merchant_label").isNotNull()
    df = with_group_facts(df, [CUSTOMER, "merchant_label"], {"c_m_label_t_count": F.count(ID)}, hot)
    if pair_count:
        df = df.withColumn("c_m_t_count", F.col(pair_count))
    else:
        df = with_group_facts(df, PAIR, {"c_m_t_count": F.count(ID)}, hot)
    return df.withColumns(
        {
            "c_m_t_count": F.when(labelled, F.col("c_m_t_count")),
            "c_m_label_t_count": F.when(labelled, F.col("c_m_label_t_count")),
            feature: F.when(labelled, F.col("c_m_t_count") / F.col("c_m_label_t_count")).otherwise(0.0),
        }
    )


def frequency_difference(
    df: DataFrame,
    feature: str = "c_freq_diff",
    method: str = "minmax",
    positive: str = "customer_freq",
    hot: HotKeys | None = None,
) -> DataFrame:
    """How much sooner a transaction came than the customer's usual gap.

    The first transaction of a customer has no gap and is dropped. Where the gap is not shorter
    than usual the score is ``customer_freq``, or 0 with ``positive='zero'``.
    """
    frame = df
    usual, gap = F.col("customer_freq"), F.col("day_diff")

    def work(part: DataFrame, weight: HotKeys) -> DataFrame:
        facts = {"__since": F.min(TIME), "__n": F.count(ID)}
        part = with_group_facts(part, [CUSTOMER], facts, weight)
        part = with_previous_time(part, [CUSTOMER], TIME, ID, "__prev", weight)
        part = (
            part.where(F.col("__prev").isNotNull())
            .withColumn("customer_freq", hours_until_reference(frame, F.col("__since")) / F.col("__n"))
            .withColumn("day_diff", hours_between(F.col(TIME), F.col("__prev")))
            .withColumn(
                feature,
                F.when(usual > gap, usual - gap).otherwise(
                    F.lit(0.0) if positive == "zero" else usual
                ),
            )
            .drop("__since", "__n", "__prev")
        )
        return normalised(part, feature, [CUSTOMER], method, weight)

    return in_parts(df, [CUSTOMER], hot, work)


def amount_change(
    df: DataFrame,
    feature: str = "c_m_med_amount_change",
    method: str = "minmax",
    min_transactions: int = 5,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Distance of the amount from the pair's median; 0 for pairs with few transactions."""
    score = normalised_name(feature, method)
    few = F.col("t_transactions") < min_transactions

    def work(part: DataFrame, weight: HotKeys) -> DataFrame:
        medians = group_quantiles(part, PAIR, {"c_m_med_amount": (AMOUNT, 0.5)}, weight)
        part = with_group_facts(part, PAIR, {"t_transactions": F.count(ID)}, weight)
        part = join_hot_aware(part, medians, PAIR, weight)
        part = part.withColumn(feature, F.abs(F.col(AMOUNT) - F.col("c_m_med_amount")))
        part = normalised(part, feature, PAIR, method, weight)
        return part.withColumn(score, F.when(few, 0.0).otherwise(F.col(score)))

    return in_parts(df, PAIR, hot, work)


def second_extremes(df: DataFrame) -> DataFrame:
    """Largest, second largest, smallest and second smallest amount of each pair."""
    return with_second_extremes(pair_state(df)).select(*PAIR, *SECOND_EXTREMES)


def peak_drop(df: DataFrame, attach: str = "all", hot: HotKeys | None = None) -> DataFrame:
    """How far the largest amount of a pair stands above its second largest (peak) and the
    smallest below its second smallest (drop), scaled over all pairs.

    ``attach='extreme'`` scores only the rows holding the largest amount (for the drop, the
    smallest); the default scores every row of the pair.
    """
    # Read again for the range of the differences, so written once: one row per pair.
    pairs = with_pair_scores(settle(pair_state(df)), peak_scores())
    return peak_drop_score(attach_pairs(df, pairs, PEAK_COLUMNS, hot), attach)


def peak_drop_score(df: DataFrame, attach: str = "all") -> DataFrame:
    """The scores of ``peak_drop`` from the pair's columns on each row."""
    peak, drop = F.col(PEAK_SCORE), F.col("drop_score")
    if attach == "extreme":
        peak = F.when(F.col(AMOUNT) == F.col("amount_max"), peak)
        drop = F.when(F.col(AMOUNT) == F.col("amount_min"), drop)
    elif attach != "all":
        raise ValueError(f"unknown attach {attach!r}")
    return df.withColumns(
        {PEAK_SCORE: F.coalesce(peak, F.lit(0.0)), "drop_score": F.coalesce(drop, F.lit(0.0))}
    )


def slope(df: DataFrame, feature: str = "slope", hot: HotKeys | None = None) -> DataFrame:
    """Steepness of the three largest and of the three smallest amounts of a pair.

    The score goes to the transaction holding the extreme; all others get 0.
    """
    # Read again for the range of the slopes, so written once: one row per pair.
    pairs = with_pair_scores(settle(pair_state(df)), slope_scores())
    return slope_score(attach_pairs(df, pairs, SLOPE_COLUMNS, hot), feature)


def slope_score(df: DataFrame, feature: str = "slope") -> DataFrame:
    """The score of ``slope`` from the pair's columns on each row, which are dropped."""
    # One transaction can be both extremes of a tiny pair; null is passed over.
    sides = [F.when(F.col(ID) == F.col(f"__{s}_id"), F.col(f"__{s}_slope")) for s in ("most", "least")]
    return df.withColumn(feature, F.coalesce(F.greatest(*sides), F.lit(0.0))).drop(*SLOPE_COLUMNS)


def last_month_totals(
    df: DataFrame,
    feature: str = "last_month_totals",
    method: str = "minmax",
    gap_limit_hours: float = 30.0,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Customer's total over the last 30 days, or the own amount after a long gap.

    Needs ``day_diff`` from the frequency feature; 720 makes the limit 30 days instead of hours.
    """
    recent = F.col("has_last_month_of_transactions") == 1
    month = 30 * SECONDS_PER_DAY

    def work(part: DataFrame, weight: HotKeys) -> DataFrame:
        part = with_trailing_sum(part, [CUSTOMER], TIME, AMOUNT, month, "__month", weight)
        part = (
            part.withColumn(
                "has_last_month_of_transactions",
                F.when(F.col("day_diff") > gap_limit_hours, 0).otherwise(1),
            )
            .withColumn("last_30_days", F.col(TIME) - F.expr("INTERVAL '30' DAY"))
            .withColumn(feature, F.when(recent, F.col("__month")).otherwise(F.col(AMOUNT)))
            .drop("__month")
        )
        return normalised(part, feature, [CUSTOMER], method, weight)

    return in_parts(df, [CUSTOMER], hot, work)


def attach_customer_score(
    df: DataFrame, scores: DataFrame, feature: str = "gmm", hot: HotKeys | None = None
) -> DataFrame:
    """Put a customer-level score on transactions; customers without one score 0."""
    hot = profile(df, hot)
    joined = join_hot_aware(df.drop(feature), scores.select(CUSTOMER, feature), (CUSTOMER,), hot)
    return joined.withColumn(feature, F.coalesce(F.col(feature), F.lit(0.0)))


def danger_totals(
    df: DataFrame, scores: DataFrame, features: list[str], hot: HotKeys | None = None
) -> DataFrame:
    """Row-wise feature total next to the customer's score from ``scores``."""
    renamed = scores.select(CUSTOMER, F.col("score").alias("gmm_min_max_p_value"))
    joined = join_hot_aware(df, renamed, (CUSTOMER,), profile(df, hot))
    return joined.withColumn("total_danger_value", row_total(features))


def daily_sequence(df: DataFrame, hot: HotKeys | None = None) -> DataFrame:
    """One row per pair and day from the pair's first hour up to, not including, its last hour.

    Days are 24-hour steps; where nothing happened at that very hour the amount is 0.
    """
    key = [*PAIR, TIME]
    hot = profile(df, hot)
    counts = df.groupBy(*key).agg(F.count(ID).alias("hour_count"))
    hourly = join_same(counts, group_quantiles(df, key, {AMOUNT: (AMOUNT, 0.5)}, hot), key, "inner")
    spans = hourly.groupBy(*PAIR).agg(
        F.min(TIME).alias("__start"), F.max(TIME).alias("__end"), F.count(TIME).alias("n_hour_groups")
    )
    whole = df.agg(
        F.floor(hours_between(F.max(TIME), F.min(TIME)) / 24).alias("d")
    ).scalar()
    calendar = (
        spans.where(F.col("__start") < F.col("__end"))
        .withColumn(
            TIME,
            F.explode(
                F.sequence(
                    F.col("__start"),
                    F.col("__end") - F.expr("INTERVAL '1' SECOND"),
                    F.expr("INTERVAL '1' DAY"),
                )
            ),
        )
        .drop("__start", "__end")
    )
    return (
        join_same(calendar, hourly, key)
        .withColumn("total_days", whole)
        .withColumn(AMOUNT, F.coalesce(F.col(AMOUNT), F.lit(0.0)))
        .withColumn(PAIR_TEXT, text_key(*[F.col(k) for k in PAIR]))
        .withColumn(HOUR, F.hour(TIME))
        .withColumn("day_part", day_part(F.col(HOUR)))
    )


def daily_customer(df: DataFrame) -> DataFrame:
    """Mean, max, min and total amount and number of transactions per customer and day."""
    return df.groupBy(CUSTOMER, F.to_date(TIME).alias("day")).agg(
        F.avg(AMOUNT).alias("amount_mean"),
        F.max(AMOUNT).alias("amount_max"),
        F.min(AMOUNT).alias("amount_min"),
        F.sum(AMOUNT).alias("amount_total"),
        F.count(ID).alias("transaction_count"),
    )


def attach_daily_counts(
    df: DataFrame, on: str = "customer_day", hot: HotKeys | None = None
) -> DataFrame:
    """Number of transactions of the customer on that day on each transaction.

    ``on='customer'`` repeats each transaction once per active day of its customer.
    """
    df = df.withColumn("day", F.to_date(TIME))
    if on == "customer_day":
        return with_group_facts(df, [CUSTOMER, "day"], {"transaction_count": F.count(ID)}, profile(df, hot))
    if on != "customer":
        raise ValueError(f"unknown join {on!r}")
    # The list is as long as the calendar, so a hot customer brings one array, not a hot join.
    per_day = daily_customer(df).groupBy(CUSTOMER).agg(
        F.collect_list("transaction_count").alias("__counts")
    )
    joined = join_hot_aware(df, per_day, (CUSTOMER,), profile(df, hot))
    return joined.withColumn("transaction_count", F.explode("__counts")).drop("__counts")


def customer_encoder(df: DataFrame) -> DataFrame:
    """Dense 0-based index of customers by mean daily number of transactions."""
    means = daily_customer(df).groupBy(CUSTOMER).agg(F.avg("transaction_count").alias("mean_count"))
    return with_row_index(means, ["mean_count", CUSTOMER], "customers")


__all__ = [
    "PEAK_SCORE", "amount_change", "attach_customer_score", "attach_daily_counts", "customer_encoder",
    "daily_customer", "daily_sequence", "danger_totals", "frequency_difference",
    "last_month_totals", "merchant_ratio", "peak_drop", "peak_drop_score", "second_extremes", "slope", "slope_score",
]
