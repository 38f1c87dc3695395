"""Running registered features in order."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame

from oddlot.operators import features as f
from oddlot.operators import pair_state as ps
from oddlot.operators.clean import MIN_TRANSACTIONS, replaced_columns, with_last_activity
from oddlot.operators.clusters import cluster_merchants, customer_mixture_scores
from oddlot.operators.skew import HotKeys, find_hot_keys
from oddlot.operators.stats import MIN_MAX_SUFFIX, P_VALUE_SUFFIX, h0_labels, h0_target, normalised_name
from oddlot.session import settle

Step = Callable[[DataFrame, str, HotKeys], DataFrame]


@dataclass(frozen=True)
class FeatureSpec:
    """How a feature is computed, what it adds, and whether its score is a normalised column.

    ``of_pairs`` gives scores of the state of the pairs, which come with ``pair_columns`` to the rows;
    ``compute`` then works row by row.
    ``drops_rows`` says that fewer rows come out than go in, so that pairs have to be counted again.
    """

    title: str
    compute: Step
    adds: tuple[str, ...]
    normalised: bool = False
    min_transactions: int | None = MIN_TRANSACTIONS
    drops_rows: bool = False
    of_pairs: Callable[[], dict[str, Column]] | None = None
    pair_columns: tuple[str, ...] = ()


def _ratios(df: DataFrame, method: str, hot: HotKeys) -> DataFrame:
    labels = cluster_merchants(df, hot=hot)
    known = ps.FREQUENCY if ps.FREQUENCY in df.columns else None
    return f.merchant_ratio(df, labels, hot=hot, pair_count=known)


def _mixture(df: DataFrame, method: str, hot: HotKeys) -> DataFrame:
    return f.attach_customer_score(df, customer_mixture_scores(df, hot=hot), hot=hot)


FEATURES: dict[str, FeatureSpec] = {
    "c_m_ratios": FeatureSpec(
        "Customer-merchant transaction ratio",
        _ratios,
        ("m_recency", "m_frequency", "m_monetary", "merchant_label", "c_m_t_count",
         "c_m_label_t_count", "c_m_ratios"),
    ),
    "c_freq_diff": FeatureSpec(
        "Sooner than the customer's usual gap",
        lambda df, method, hot: f.frequency_difference(df, method=method, hot=hot),
        ("customer_freq", "day_diff", "c_freq_diff"),
        normalised=True,
        drops_rows=True,
    ),
    f.PEAK_SCORE: FeatureSpec(
        "Abnormal peak and drop of the pair",
        lambda df, method, hot: f.peak_drop_score(df),
        ps.PEAK_COLUMNS,
        of_pairs=ps.peak_scores,
        pair_columns=ps.PEAK_COLUMNS,
    ),
    "slope": FeatureSpec(
        "Slope of the pair's extreme amounts",
        lambda df, method, hot: f.slope_score(df),
        ("slope",),
        of_pairs=ps.slope_scores,
        pair_columns=ps.SLOPE_COLUMNS,
    ),
    "gmm": FeatureSpec("Customer outside its mixture component", _mixture, ("gmm",)),
    "c_m_med_amount_change": FeatureSpec(
        "Distance from the pair's median amount",
        lambda df, method, hot: f.amount_change(df, method=method, hot=hot),
        ("c_m_med_amount", "t_transactions", "c_m_med_amount_change"),
        normalised=True,
    ),
    "last_month_totals": FeatureSpec(
        "Customer's total over the last month",
        lambda df, method, hot: f.last_month_totals(df, method=method, hot=hot),
        ("has_last_month_of_transactions", "last_30_days", "last_month_totals"),
        normalised=True,
    ),
}
DEFAULT_FEATURES = ("c_m_ratios", "c_freq_diff", f.PEAK_SCORE, "slope", "gmm")


def resolve(names: str | list[str] | tuple[str, ...] = "all") -> list[str]:
    """Registered names from ``'all'``, a list, or ``'a-b-c'``; normalised names are accepted."""
    if names == "all":
        return list(DEFAULT_FEATURES)
    wanted = names.split("-") if isinstance(names, str) else list(names)
    found = []
    for name in wanted:
        if name not in FEATURES:
            for suffix in (MIN_MAX_SUFFIX, P_VALUE_SUFFIX):
                if name.endswith(suffix) and name.removesuffix(suffix) in FEATURES:
                    name = name.removesuffix(suffix)
                    break
            else:
                raise KeyError(f"no feature named {name!r}")
        found.append(name)
    # Order is part of the result: the registry's order wins.
    return [n for n in FEATURES if n in found]


def score_columns(names: str | list[str] | tuple[str, ...] = "all", method: str = "minmax") -> list[str]:
    """Columns the detectors read: the normalised column where the feature is normalised."""
    return [normalised_name(n, method) if FEATURES[n].normalised else n for n in resolve(names)]


def stretches(chosen: list[str]) -> list[list[str]]:
    """Runs of features over the same rows: a stretch ends where rows are dropped or the rule for
    noisy pairs changes."""
    out: list[list[str]] = []
    for name in chosen:
        before = FEATURES[out[-1][-1]] if out else None
        if before is None or before.drops_rows or before.min_transactions != FEATURES[name].min_transactions:
            out.append([])
        out[-1].append(name)
    return out


def _with_pairs(df: DataFrame, names: list[str], hot: HotKeys) -> DataFrame:
    """Rows of the pairs that stay, with every column of the pair that the stretch needs."""
    specs = [FEATURES[n] for n in names]
    least = specs[0].min_transactions
    wanted = [ps.FREQUENCY] if least else []
    if not least and not any(s.of_pairs for s in specs):
        return df
    # Written once: rule, ranges and the join read it, one row per pair.
    pairs = settle(ps.pair_state(df))
    if least:
        pairs = pairs.where(ps.enough(pairs, least))
    scored = [s for s in specs if s.of_pairs]
    if scored:
        pairs = ps.with_pair_scores(pairs, *[s.of_pairs() for s in scored])
        wanted += [c for s in scored for c in s.pair_columns]
    return settle(ps.attach_pairs(df, pairs, wanted, hot, drop=bool(least)))


def run_features(
    df: DataFrame,
    names: str | list[str] | tuple[str, ...] = "all",
    method: str = "minmax",
    h0_alpha: float | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Clean and compute each feature in registry order, then flag the last activity.

    Keys are counted for hotness once, and pairs once between steps that drop rows. A feature that
    refers to its input several times is written before the next one starts. ``h0_alpha`` adds
    hypothesis labels per feature and the common target.
    """
    hot = hot or find_hot_keys(df)
    labelled = []
    for names_of_stretch in stretches(resolve(names)):
        for name in names_of_stretch:
            df = replaced_columns(df, [*FEATURES[name].adds, name + MIN_MAX_SUFFIX, name + P_VALUE_SUFFIX])
        df = _with_pairs(df, names_of_stretch, hot)
        for name in names_of_stretch:
            spec = FEATURES[name]
            df = spec.compute(df, method, hot)
            if not spec.of_pairs:
                df = settle(df)
            if h0_alpha is not None:
                column = score_columns([name], method)[0]
                df = h0_labels(df, [column], h0_alpha)
                labelled.append(column)
    if labelled:
        df = h0_target(df, labelled)
    return with_last_activity(df, hot=hot)


__all__ = ["DEFAULT_FEATURES", "FEATURES", "FeatureSpec", "resolve", "run_features", "score_columns", "stretches"]
