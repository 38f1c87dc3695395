"""Two-sided mass of Student's t distribution as native expressions.

For a statistic t >= 0 the probability score is |2 * CDF(t) - 1|, which is the mass A(t | nu)
between -t and t. For whole degrees of freedom A is a finite trigonometric sum (Abramowitz &
Stegun 26.7.3/26.7.4). Above ``SUM_LIMIT`` degrees the density is integrated by Gauss-Legendre
quadrature, with the gamma ratio taken from its asymptotic series.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SUM_LIMIT = 200
QUADRATURE_NODES = 48
# Beyond this statistic the tail is below 1e-20 for more than SUM_LIMIT degrees of freedom.
TAIL_CUT = 12.0


def t_statistic(value: Column, mean: Column, std: Column, count: Column) -> Column:
    """|x - mean| / (std * sqrt(2 / count)); null for an empty or constant group."""
    scale = std * F.sqrt(F.try_divide(F.lit(2.0), count))
    return F.try_divide(F.abs(value - mean), scale)


def _finite_sum(t: Column, nu: Column) -> Column:
    angle = F.atan(t / F.sqrt(nu.cast("double")))
    sine, cosine = F.sin(angle), F.cos(angle)
    odd = F.pmod(nu, F.lit(2))
    first = F.when(odd == 1, cosine).otherwise(F.lit(1.0))
    squared = cosine * cosine
    steps = F.when(nu >= 4, F.sequence(F.lit(1), ((nu - 2) / 2).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )

    def advance(acc: Column, k: Column) -> Column:
        term = acc["term"] * squared * (2 * k - 1 + odd) / (2 * k + odd)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    series = F.aggregate(
        steps,
        F.struct(first.alias("term"), first.alias("total")),
        advance,
        lambda acc: acc["total"],
    )
    two_over_pi = F.lit(2.0 / math.pi)
    return (
        F.when(nu == 1, two_over_pi * angle)
        .when(odd == 1, two_over_pi * (angle + sine * series))
        .otherwise(sine * series)
    )


def _quadrature(t: Column, nu: Column) -> Column:
    nodes, weights = np.polynomial.legendre.leggauss(QUADRATURE_NODES)
    table = F.array(
        *[
            F.struct(F.lit(float((x + 1) / 2)).alias("x"), F.lit(float(w)).alias("w"))
            for x, w in zip(nodes, weights)
        ]
    )
    n = nu.cast("double")
    inv = F.lit(1.0) / n
    # Gamma((n+1)/2) / (Gamma(n/2) * sqrt(n/2)): coefficients of the asymptotic series in 1/n.
    gamma_ratio = (
        F.lit(1.0)
        - inv / 4.0
        + inv * inv / 32.0
        + inv * inv * inv * (5.0 / 128.0)
        - inv * inv * inv * inv * (21.0 / 2048.0)
    )
    upper = F.least(t, F.lit(TAIL_CUT))
    area = F.aggregate(
        table,
        F.lit(0.0),
        lambda acc, p: acc
        + p["w"]
        * F.exp(-(n + 1.0) / 2.0 * F.log1p(upper * upper * p["x"] * p["x"] * inv)),
    )
    # density constant = gamma_ratio / sqrt(2 pi); half-width upper/2, both sides -> factor 2.
    mass = F.least(F.lit(1.0), gamma_ratio / math.sqrt(2 * math.pi) * upper * area)
    return F.when(t >= TAIL_CUT, F.lit(1.0)).otherwise(mass)


def two_sided_mass(t: Column, nu: Column) -> Column:
    """A(t | nu) for t >= 0 and whole nu >= 1; null otherwise."""
    usable = t.isNotNull() & (nu >= 1)
    return F.when(usable & (nu <= SUM_LIMIT), _finite_sum(t, nu)).when(
        usable, _quadrature(t, nu)
    )
