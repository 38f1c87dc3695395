"""Questions asked about scored transactions: samples, summaries, top lists and drill-through."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddlot.columns import AMOUNT, CUSTOMER, ID, MERCHANT, PAIR, PAIR_TEXT, RAW_TIME, TIME
from oddlot.operators.clean import keep_members
from oddlot.operators.quantiles import table_quantiles
from oddlot.operators.sampling import sample_exact
from oddlot.operators.skew import join_same

# Sample ratios offered.
SAMPLE_RATIOS = (0.2, 0.3, 0.4, 0.5, 0.75)
TOP_QUANTILE = 0.99
RELATED = (
    ID, PAIR_TEXT, MERCHANT, CUSTOMER, AMOUNT, TIME, "c_m_label_t_count", "c_m_t_count",
    "c_freq_diff", RAW_TIME,
)


def history(train: DataFrame, predictions: DataFrame, features: list[str], labels: list[str]) -> DataFrame:
    """Training rows with neutral labels followed by the predicted rows; rows without amount drop."""
    kept = [c for c in RELATED if c in train.columns]
    first = train.select(*dict.fromkeys([*kept, *features])).withColumns({m: F.lit(0) for m in labels})
    second = predictions.select(*[c for c in kept if c in predictions.columns])
    return first.unionByName(second, allowMissingColumns=True).where(F.col(AMOUNT).isNotNull())


def pair_summary(df: DataFrame, label: str = "label_iso") -> DataFrame:
    return df.groupBy(*PAIR).agg(
        F.max("c_m_label_t_count").alias("c_m_label_t_count"),
        F.max("c_m_t_count").alias("c_m_t_count"),
        F.sum(label).alias(label),
    )


def bias_condition(df: DataFrame, value: str, slope: str = "slope") -> Column:
    """Rows in the top percent of the value, or holding a slope."""
    cut = table_quantiles(df, {"cut": (value, TOP_QUANTILE)})["cut"]
    return F.coalesce((F.col(value) > cut) | (F.col(slope) > 0), F.lit(False))


def biased_sample(
    df: DataFrame, ratio: float, value: str = "anomaly_ae_values", slope: str = "slope", seed: int = 0,
    ident: str = ID,
) -> DataFrame:
    """A random share of the rows together with every row that meets the bias condition."""
    total = df.count()
    bias = bias_condition(df, value, slope)
    drawn = sample_exact(df, int(total * ratio), seed, ident, total)
    return df.where(bias).unionByName(drawn.where(~bias))


def of_customers(df: DataFrame, sample: DataFrame) -> DataFrame:
    """Restrict a table to the customers of a sample."""
    return keep_members(df, sample, CUSTOMER)


def top_entities(df: DataFrame, key: str, score: str, n: int = 100) -> DataFrame:
    """The ``n`` entities with the highest score in any of their rows."""
    best = df.groupBy(key).agg(F.max(score).alias(score))
    return best.orderBy(F.desc(score), key).limit(n)


def scatter(
    df: DataFrame, x: str, y: str, z: str, label: str, customer="ALL", merchant="ALL"
) -> DataFrame:
    if customer != "ALL":
        df = df.where(F.col(CUSTOMER) == F.lit(customer))
    if merchant != "ALL":
        df = df.where(F.col(MERCHANT) == F.lit(merchant))
    return df.select(ID, *dict.fromkeys([x, y, z, label]))


def transaction_detail(df: DataFrame, ident) -> DataFrame:
    return df.where(F.col(ID) == F.lit(ident))


def customer_pairs_of(summary: DataFrame, df: DataFrame, ident) -> DataFrame:
    """Pair summary of the customer of one transaction."""
    owner = F.broadcast(transaction_detail(df, ident).select(CUSTOMER).limit(1))
    return join_same(summary, owner, [CUSTOMER], "left_semi")


def pair_history_of(df: DataFrame, ident, columns: list[str]) -> DataFrame:
    """What the pair of one transaction did over time."""
    owner = F.broadcast(transaction_detail(df, ident).select(*PAIR).limit(1))
    return join_same(df, owner, PAIR, "left_semi").select(ID, TIME, *columns)
