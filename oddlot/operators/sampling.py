"""Reproducible exact-size samples and ratio splits by hashed id."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddlot.columns import ID
from oddlot.functions.scalars import md5_rank, md5_unit
from oddlot.operators.quantiles import kth_smallest


def sample_exact(
    df: DataFrame, n: int, seed: int = 0, ident: str = ID, total: int | None = None
) -> DataFrame:
    """``n`` rows without replacement: those with the smallest (hash, id); null ids come last.

    The rank-``n`` hash is found first and rows are kept by a plain filter, so the sample itself is
    never gathered in one task.
    """
    total = df.count() if total is None else total
    if n >= total:
        return df
    if n <= 0:
        return df.limit(0)
    order = [md5_rank(F.col(ident), seed), F.col(ident)]
    unit = F.coalesce(md5_unit(F.col(ident), seed), F.lit(1.0))
    cut = kth_smallest(df.select(unit.alias("u")), "u", n - 1, total)
    below = df.where(unit < cut)
    missing = n - below.count()
    # Rows sharing the cut's 52-bit prefix: practically always exactly one.
    return below.unionByName(df.where(unit == cut).orderBy(*order).limit(missing))


def split_ratio(df: DataFrame, ratio: float, seed: int = 1234, ident: str = ID) -> tuple[DataFrame, DataFrame]:
    """Rows whose hashed id falls below the ratio, and the rest."""
    unit = md5_unit(F.col(ident), seed)
    return df.where(unit < ratio), df.where(unit >= ratio)
