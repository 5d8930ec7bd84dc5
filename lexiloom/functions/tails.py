"""Tail probabilities of test statistics as Columns: t, F, U and the studentised range.

t and F follow from the regularised incomplete beta function, by its continued fraction; the studentised range from
a double integral, by the trapezoid rule, which for integrands that vanish smoothly at both ends is exact to rounding.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import named

#: Lanczos' approximation of the gamma function, g = 7.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Hart's rational approximation of the normal tail, numerator and denominator from the highest power.
HART = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
HART_BELOW = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Steps of the continued fraction; it needs about the root of the larger parameter.
STEPS = 2000
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function of x, half or more."""
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:]):
        total = total + F.lit(c) / (x + i)
    t = x + 6.5
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.ln(t) - t + F.ln(total)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, by Lentz's method; steps after it has settled change nothing."""
    safe = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    first = named(1 / safe(1 - (a + b) * x / (a + 1)), lambda d: state(F.lit(1.0), d, d))

    def half(s: Column, k: Column) -> Column:
        return named(F.struct((1 / safe(1 + k * s["d"])).alias("d"), safe(1 + k / s["c"]).alias("c")), lambda n: state(n["c"], n["d"], s["h"] * n["d"] * n["c"]))

    def step(s: Column, i: Column) -> Column:
        m = i.cast("double")
        even, odd = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return named(half(s, even), lambda n: half(n, odd))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, step, lambda s: s["h"])


def incomplete_beta(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function of x from 0 to 1."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    swap = x >= (a + 1) / (a + b + 2)
    chosen = F.struct(F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b"), F.when(swap, 1 - x).otherwise(x).alias("x"), front.alias("front"), swap.alias("swap"))
    inner = named(chosen, lambda v: named(v["front"] * _fraction(v["a"], v["b"], v["x"]) / v["a"], lambda p: F.when(v["swap"], 1 - p).otherwise(p)))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(inner)


def t_tail(t: Column, df: Column) -> Column:
    """The chance of a t statistic as far from 0, on either side."""
    return incomplete_beta(df / 2, F.lit(0.5), df / (df + t * t))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """The chance of an F statistic as large."""
    return incomplete_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def normal_tail(x: Column) -> Column:
    """The chance of a standard normal value above x."""

    def polynomial(coefficients: tuple[float, ...], z: Column) -> Column:
        out = F.lit(coefficients[0])
        for c in coefficients[1:]:
            out = out * z + c
        return out

    def upper(z: Column) -> Column:
        near = polynomial(HART, z) / polynomial(HART_BELOW, z)
        far = 1 / ((z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))) * F.lit(math.sqrt(2 * math.pi)))
        return F.exp(-z * z / 2) * F.when(z < 7.07106781186547, near).otherwise(far)

    return named(F.abs(x), lambda z: named(upper(z), lambda p: F.when(x > 0, p).otherwise(1 - p)))


def u_tail(u: Column, n1: Column, n2: Column) -> Column:
    """The two-sided chance of a Mann-Whitney U as far from its mean, by the normal distribution with a correction of half a step, without one for ties."""
    spread = F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12.0)
    return F.least(F.lit(1.0), 2 * normal_tail((F.abs(u - n1 * n2 / 2.0) - 0.5) / spread))


#: Points on either side of the middle in each integral of the studentised range, and how far the inner one reaches.
POINTS, REACH = 60, 8.0


def range_tail(q: Column, k: Column, df: Column) -> Column:
    """The chance that the range of k normal values, over an independent estimate of their deviation with df degrees of freedom, exceeds q."""
    nodes = F.sequence(F.lit(-POINTS), F.lit(POINTS))
    dz = REACH / POINTS
    density = lambda z: F.exp(-z * z / 2) / math.sqrt(2 * math.pi)

    def below(w: Column) -> Column:
        """The chance that the range of k values stays below w: one is the largest, and the others lie within w of it."""
        one = lambda s, i: named(i * dz, lambda z: s + k * density(z) * F.pow(normal_tail(z - w) - normal_tail(z), k - 1) * dz)
        return F.aggregate(nodes, F.lit(0.0), one)

    def integral(v: Column) -> Column:
        reach, log_front = v["reach"], v["front"]
        du = reach / POINTS
        # the deviation is exp(u); its density times exp(u) is what is summed
        one = lambda s, i: named(i * du, lambda u: s + F.exp(log_front + v["df"] * u - v["df"] * F.exp(2 * u) / 2) * below(v["q"] * F.exp(u)) * du)
        return F.aggregate(nodes, F.lit(0.0), one)

    half = df / 2.0
    front = F.lit(math.log(2.0)) + half * F.ln(half) - log_gamma(half)
    parts = F.struct(q.cast("double").alias("q"), df.cast("double").alias("df"), front.alias("front"), F.least(F.lit(9.0), 9 / F.sqrt(2.0 * df)).alias("reach"))
    return named(parts, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - integral(v))))
