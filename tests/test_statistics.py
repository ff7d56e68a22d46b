"""Student's t against closed forms, printed tables and numerical integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeglint.functions import statistics as S

#: df, alpha, the t that alpha / 2 lies beyond (fixed values of printed tables).
CRITICAL = ((1, 0.05, 12.706204736432095), (2, 0.05, 4.302652729911275), (10, 0.05, 2.2281388519649385), (30, 0.05, 2.0422724563012373), (120, 0.01, 2.617421145106865), (1000, 0.05, 1.9623390808264078))


def closed(t, df):
    t = abs(t)
    if df == 1:
        return 1 - 2 / math.pi * math.atan(t)
    if df == 2:
        return 1 - t / math.sqrt(2 + t * t)
    return 1 - t / math.sqrt(4 + t * t) * (1 + 2 / (4 + t * t))


def test_two_sided(spark):
    rows = [(float(t), df) for df in (1, 2, 4) for t in (0, 0.001, -0.3, 0.7, 1.0, 1.7320508, 2.5, 10, -40)]
    for r in spark.createDataFrame(rows, "t double, df int").select("t", "df", S.t_two_sided(F.col("t"), F.col("df")).alias("p")).collect():
        assert r.p == pytest.approx(closed(r.t, r.df), abs=1e-12)


def test_critical_values(spark):
    for alpha in (0.05, 0.01):
        rows = [(df, want) for df, a, want in CRITICAL if a == alpha]
        for r in spark.createDataFrame(rows, "df int, want double").select("want", S.t_critical(alpha, F.col("df")).alias("t")).collect():
            assert r.t == pytest.approx(r.want, rel=1e-9)
    far = spark.createDataFrame([(10**8,)], "df long").select(S.t_two_sided(F.lit(1.959963984540054), F.col("df")).alias("p")).first().p
    assert far == pytest.approx(0.05, abs=1e-8)


def integrated(t, df, shift):
    """P(T > t) by Simpson's rule over the spread's distribution."""
    s = np.linspace(1e-9, 1 + 14 / math.sqrt(2 * df) + 3, 20_001)
    log_f = math.log(2) + df / 2 * math.log(df / 2) + (df - 1) * np.log(s) - df * s * s / 2 - math.lgamma(df / 2)
    above = np.array([0.5 * math.erfc((t * x - shift) / math.sqrt(2)) for x in s])
    w = np.ones(len(s))
    w[1:-1:2], w[2:-1:2] = 4, 2
    return float((w * np.exp(log_f) * above).sum() * (s[1] - s[0]) / 3)


def test_power(spark):
    rows = [(t, df, shift) for t, df in ((2.2, 10), (2.0, 30), (1.97, 200), (3.5, 3)) for shift in (0.0, 0.2, -1.3, 2.5, 8.0, 20.0)]
    df = spark.createDataFrame(rows, "t double, df int, shift double")
    for r in df.select("*", S.t_power(F.col("t"), F.col("df"), F.col("shift")).alias("p")).collect():
        assert r.p == pytest.approx(integrated(r.t, r.df, r.shift), abs=1e-9)


def test_edges(spark):
    r = spark.range(1).select(S.t_two_sided(F.lit(1.0), F.lit(0)).alias("a"), S.t_two_sided(F.lit(None).cast("double"), F.lit(3)).alias("b"), S.t_two_sided(F.lit(0.0), F.lit(3)).alias("c"), S.t_two_sided(F.lit(1e200), F.lit(3)).alias("d")).first()
    assert (r.a, r.b, r.c) == (None, None, 1.0) and (r.d is None or r.d < 1e-100 or math.isnan(r.d) or r.d == 0)
