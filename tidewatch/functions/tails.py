"""Tail probabilities as columns.

Arguments are SQL expressions (usually column names). The columns are evaluated on one row per report,
after the heavy aggregation, so the loops inside are over terms of a series and not over data.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_LOG_TWO_PI = 0.5 * math.log(2 * math.pi)


def _log_gamma(z: str) -> str:
    """Stirling's series after shifting the argument up by ten."""
    up = f"({z} + 10)"
    shift = " + ".join(f"ln({z} + {i})" for i in range(10))
    series = f"1 / (12 * {up}) - 1 / (360 * pow({up}, 3)) + 1 / (1260 * pow({up}, 5)) - 1 / (1680 * pow({up}, 7))"
    return f"(({up} - 0.5D) * ln({up}) - {up} + {HALF_LOG_TWO_PI!r}D + {series} - ({shift}))"


def _gamma_tail(a: str, x: str) -> str:
    """Regularised upper incomplete gamma: power series below a + 1, continued fraction above."""
    a, x = f"({a})", f"({x})"
    front = f"exp({a} * ln({x}) - {x} - {_log_gamma(a)})"
    rounds = f"cast(200 + 10 * sqrt({a}) as int)"
    lower = (
        f"aggregate(sequence(1, {rounds}), named_struct('term', 1 / {a}, 'total', 1 / {a}), "
        f"(s, i) -> named_struct('term', s.term * {x} / ({a} + i), 'total', s.total + s.term * {x} / ({a} + i)), s -> s.total)"
    )
    # Backward evaluation of 1/(x+1-a - 1(1-a)/(x+3-a - 2(2-a)/(x+5-a - ...))).
    fraction = (
        f"aggregate(reverse(sequence(1, {rounds})), 0D, "
        f"(rest, i) -> i * (i - {a}) / ({x} + 2 * i + 1 - {a} - rest))"
    )
    tail = f"if({x} < {a} + 1, 1 - {front} * {lower}, {front} / ({x} + 1 - {a} - {fraction}))"
    return f"if({x} <= 0, 1D, least(greatest({tail}, 0D), 1D))"


def chi2_tail(statistic: str, freedom: str) -> Column:
    """P(X >= statistic) for a chi-square variable."""
    return F.expr(_gamma_tail(f"cast({freedom} as double) / 2", f"cast({statistic} as double) / 2"))


def normal_two_sided(z: str) -> Column:
    """P(|Z| >= |z|), through the chi-square with one degree of freedom."""
    return chi2_tail(f"({z}) * ({z})", "1")


def ks_tail(distance: str, n: str, m: str) -> Column:
    """Asymptotic two-sample Kolmogorov-Smirnov p-value."""
    scaled = f"({distance} * sqrt(cast({n} as double) * {m} / ({n} + {m})))"
    series = (
        f"aggregate(sequence(1, 100), 0D, "
        f"(total, k) -> total + if(k % 2 = 1, 2D, -2D) * exp(-2D * k * k * {scaled} * {scaled}))"
    )
    return F.expr(f"if({scaled} < 0.04D, 1D, least(greatest({series}, 0D), 1D))")


def binomial_half_two_sided(successes: str, trials: str) -> Column:
    """Exact two-sided binomial test at one half: twice the smaller tail, at most 1."""
    smaller = f"cast(least({successes}, {trials} - {successes}) as int)"
    tail = (
        f"aggregate(sequence(0, {smaller}), named_struct('term', pow(0.5D, {trials}), 'total', 0D), "
        f"(s, i) -> named_struct('term', s.term * ({trials} - i) / (i + 1), 'total', s.total + s.term), s -> s.total)"
    )
    return F.expr(f"least(2 * {tail}, 1D)")
