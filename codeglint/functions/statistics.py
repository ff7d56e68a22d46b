"""Distributions as column expressions: the incomplete beta function, Student's t, its quantiles, and the power of a t test."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stirling's correction of ln gamma in odd powers of 1 / z (fixed values), and how far an argument is raised before it is used.
STIRLING = ((1, 1 / 12), (3, -1 / 360), (5, 1 / 1260), (7, -1 / 1680), (9, 1 / 1188))
RAISED = 10
#: Steps of the continued fraction: so many, and so many times the root of the larger parameter.
STEPS, STEPS_BY_ROOT = 60, 4
#: Halvings of an angle that find a quantile.
HALVINGS = 54
#: Of a Poisson series the terms within so many standard deviations of the mean, and so many more.
SPREAD, MORE_TERMS = 10, 40
_LEAST = 1e-300


def _bound(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _correction(z: Column) -> Column:
    out = F.lit(0.0)
    for power, c in STIRLING:
        out = out + c / F.pow(z, F.lit(float(power)))
    return out


def log_gamma(z: Column) -> Column:
    """ln of gamma of z > 0."""
    up = z + RAISED
    raised = (up - 0.5) * F.log(up) - up + 0.5 * math.log(2 * math.pi) + _correction(up)
    for k in range(RAISED):
        raised = raised - F.log(z + k)
    return raised


def _log_rise(a: Column, b: Column) -> Column:
    """ln of gamma(a + b) / gamma(a), without the difference of two large numbers."""
    up = a + RAISED
    out = (up - 0.5) * F.log1p(b / up) + b * F.log(up + b) - b + _correction(up + b) - _correction(up)
    for k in range(RAISED):
        out = out - F.log1p(b / (a + k))
    return out


def log_beta(a: Column, b: Column) -> Column:
    low, high = F.least(a, b), F.greatest(a, b)
    return log_gamma(low) - _log_rise(high, low)


def _away(x: Column) -> Column:
    return F.when(F.abs(x) < _LEAST, F.lit(_LEAST)).otherwise(x)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function by its even and odd steps, from the front."""

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d1, c1 = 1 / _away(1 + even * s["d"]), _away(1 + even / s["c"])
        d2, c2 = 1 / _away(1 + odd * d1), _away(1 + odd / c1)
        return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

    first = 1 / _away(1 - (a + b) * x / (a + 1))
    steps = F.sequence(F.lit(1), (STEPS + STEPS_BY_ROOT * F.sqrt(F.greatest(a, b))).cast("int"))
    return F.aggregate(F.transform(steps, lambda m: m.cast("double")), F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h")), step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column, y: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b); y is 1 - x, given apart so that neither loses digits."""

    def value(p: Column) -> Column:
        front = p["a"] * F.when(p["x"] > 0.5, F.log1p(-p["y"])).otherwise(F.log(p["x"])) + p["b"] * F.when(p["y"] > 0.5, F.log1p(-p["x"])).otherwise(F.log(p["y"]))
        inside = F.exp(front - log_beta(p["a"], p["b"])) * _fraction(p["a"], p["b"], p["x"]) / p["a"]
        return F.when(p["x"] <= 0, F.when(p["turned"], 1.0).otherwise(0.0)).when(p["y"] <= 0, F.when(p["turned"], 0.0).otherwise(1.0)).when(p["turned"], 1 - inside).otherwise(inside)

    def turned(p: Column) -> Column:
        turn = p["x"] > (p["a"] + 1) / (p["a"] + p["b"] + 2)
        pick = lambda n, m: F.when(turn, p[m]).otherwise(p[n])
        return _bound(F.struct(pick("a", "b").alias("a"), pick("b", "a").alias("b"), pick("x", "y").alias("x"), pick("y", "x").alias("y"), turn.alias("turned")), value)

    d = lambda c, n: c.cast("double").alias(n)
    return _bound(F.struct(d(a, "a"), d(b, "b"), d(x, "x"), d(y, "y")), turned)


def t_two_sided(t: Column, df: Column) -> Column:
    """Probability of a value of Student's t as far from 0 as t or farther; 1 for t = 0, null for null or df of 0."""
    square = t * t
    return F.when(df > 0, incomplete_beta(df / 2, F.lit(0.5), df / (df + square), square / (df + square)))


def t_critical(alpha: float, df: Column) -> Column:
    """The t that alpha / 2 of the distribution lies beyond, by halving the angle whose tangent is t / sqrt(df)."""

    def halved(n: Column) -> Column:
        def step(s: Column, _: Column) -> Column:
            angle = (s["low"] + s["high"]) / 2
            beyond = _bound(F.tan(angle) * F.sqrt(n), lambda t: t_two_sided(t, n)) > alpha
            return F.struct(F.when(beyond, angle).otherwise(s["low"]).alias("low"), F.when(beyond, s["high"]).otherwise(angle).alias("high"))

        start = F.struct(F.lit(0.0).alias("low"), F.lit(math.pi / 2).alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, step, lambda s: F.tan((s["low"] + s["high"]) / 2) * F.sqrt(n))

    return F.when(df > 0, _bound(df.cast("double"), halved))


def t_power(t: Column, df: Column, shift: Column) -> Column:
    """Probability that a non-central t with this shift exceeds t >= 0: a Poisson-weighted series of incomplete beta functions."""

    def series(p: Column) -> Column:
        mean = p["shift"] * p["shift"] / 2
        reach = SPREAD * F.sqrt(mean) + MORE_TERMS
        terms = F.sequence(F.greatest(F.lit(0.0), F.floor(mean - reach)).cast("int"), F.ceil(mean + reach).cast("int"))
        whole = p["df"] + p["t"] * p["t"]
        x, y = p["df"] / whole, p["t"] * p["t"] / whole

        def term(total: Column, j: Column) -> Column:
            power = F.when(mean > 0, j * F.log(mean)).otherwise(F.when(j > 0, F.lit(float("-inf"))).otherwise(F.lit(0.0))) - mean
            even = F.exp(power - log_gamma(j + 1.0)) * incomplete_beta(p["df"] / 2, j + 0.5, x, y)
            odd = p["shift"] / math.sqrt(2) * F.exp(power - log_gamma(j + 1.5)) * incomplete_beta(p["df"] / 2, j + 1.0, x, y)
            return total + (even + odd) / 2

        return F.aggregate(F.transform(terms, lambda j: j.cast("double")), F.lit(0.0), term, lambda s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), s)))

    d = lambda c, n: c.cast("double").alias(n)
    return F.when(df > 0, _bound(F.struct(d(t, "t"), d(df, "df"), d(shift, "shift")), series))
