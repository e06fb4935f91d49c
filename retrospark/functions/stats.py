"""Numeric helpers: guarded division, population std of three values, erfc, log-gamma, incomplete beta, F test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(num: Column, den: Column) -> Column:
    """num / den, null when den is 0 or null (no ANSI error)."""
    return F.when(den != 0, num / den)


def mean_present(cols: list[Column]) -> Column:
    """Mean of the non-null values among ``cols``; null when all are null."""
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols), F.lit(0.0))
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    return F.when(n > 0, total / n)


def std_pop_present(cols: list[Column]) -> Column:
    """Population std (ddof=0) of the non-null values among ``cols``; null when all null."""
    m = mean_present(cols)
    n = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in cols), F.lit(0))
    ss = sum((F.coalesce((c - m) * (c - m), F.lit(0.0)) for c in cols), F.lit(0.0))
    return F.when(n > 0, F.sqrt(ss / n))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 (Numerical Recipes erfcc, |rel err| < 1.2e-7)."""
    z = F.abs(x)
    t = F.lit(1.0) / (F.lit(1.0) + F.lit(0.5) * z)
    coeffs = [
        -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
        0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
    ]
    poly = F.lit(coeffs[-1])
    for c in reversed(coeffs[:-1]):
        poly = F.lit(c) + t * poly
    ans = t * F.exp(-z * z + poly)
    return F.when(x >= 0, ans).otherwise(F.lit(2.0) - ans)


def g_mean(sens: Column, spec: Column) -> Column:
    return F.sqrt(F.greatest(sens, F.lit(0.0)) * F.greatest(spec, F.lit(0.0)))


def log_gamma(z: Column) -> Column:
    """ln of the gamma function for z > 0: Stirling's series at z + 8, brought back by the recurrence (error below 1e-12)."""
    up, shift = z + 8, F.lit(0.0)
    for i in range(8):
        shift = shift + F.log(z + i)
    r = F.lit(1.0) / (up * up)
    series = (F.lit(1 / 12) - r * (F.lit(1 / 360) - r * (F.lit(1 / 1260) - r * (F.lit(1 / 1680) - r * F.lit(1 / 1188))))) / up
    return (up - 0.5) * F.log(up) - up + F.lit(0.9189385332046727) + series - shift


def beta_inc(a: Column, b: Column, x: Column) -> Column:
    """Regularised incomplete beta I_x(a, b) as a JVM expression.

    The continued fraction converges in some multiple of sqrt(max(a, b)) steps on the side where
    x < (a + 1) / (a + b + 2); the other side follows from I_x(a, b) = 1 - I_(1-x)(b, a).
    """
    flip = x >= (a + 1) / (a + b + 2)
    p, r, t = F.when(flip, b).otherwise(a), F.when(flip, a).otherwise(b), F.when(flip, 1 - x).otherwise(x)
    given = F.struct(p.alias("p"), r.alias("r"), t.alias("t"))
    steps = F.sequence(F.lit(1), F.ceil(F.lit(60) + 5 * F.sqrt(F.greatest(a, b))).cast("int"))
    safe = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)

    def fraction(g: Column) -> Column:
        p, r, t = g["p"], g["r"], g["t"]
        d0 = 1 / safe(1 - (p + r) * t / (p + 1))

        def step(s: Column, m: Column) -> Column:
            even = m * (r - m) * t / ((p + 2 * m - 1) * (p + 2 * m))
            odd = -(p + m) * (p + r + m) * t / ((p + 2 * m) * (p + 2 * m + 1))
            d1, c1 = 1 / safe(1 + even * s["d"]), safe(1 + even / s["c"])
            d2, c2 = 1 / safe(1 + odd * d1), safe(1 + odd / c1)
            return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d1 * c1 * d2 * c2).alias("h"))

        start = F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"))
        front = F.exp(log_gamma(p + r) - log_gamma(p) - log_gamma(r) + p * F.log(t) + r * F.log(1 - t))
        return front * F.aggregate(steps, start, step, lambda s: s["h"]) / p

    value = F.transform(F.array(given), fraction)[0]  # the sides are chosen once
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(F.when(flip, 1 - value).otherwise(value))


def f_pvalue(f: Column, df1: Column, df2: Column) -> Column:
    """P(F(df1, df2) > f): null without a value of f or degrees of freedom, 0 for an infinite f."""
    a, b = df1.cast("double"), df2.cast("double")
    usable = f.isNotNull() & ~F.isnan(f) & (a > 0) & (b > 0)
    return F.when(usable & (f == float("inf")), F.lit(0.0)).when(usable, beta_inc(b / 2, a / 2, b / (b + a * f)))
