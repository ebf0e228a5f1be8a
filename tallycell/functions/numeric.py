"""Column expressions for tails, log-factorials and orderings; all stay on the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Chebyshev coefficients of the complementary error function
# (fractional error below 1.2e-7 everywhere), lowest order first.
ERFC_COEFFICIENTS = (
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
    0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round, and turn a negative zero into zero so that hashes agree."""
    return F.round(col(c), digits) + F.lit(0.0)


def finite(c: Column | str) -> Column:
    """NULL for NaN and infinities."""
    c = col(c)
    bad = F.isnan(c) | (c == float("inf")) | (c == float("-inf"))
    return F.when(~bad, c)


def ratio(num: Column, den: Column) -> Column:
    """Division that yields NULL on a zero denominator."""
    return F.when(den != 0, num / den)


def two_sided_normal_p(z: Column | str) -> Column:
    """``2 * P(N(0,1) > |z|)`` as a rational-exponential expression."""
    a = F.abs(col(z)) / math.sqrt(2.0)
    t = 1.0 / (1.0 + a / 2.0)
    poly = F.lit(ERFC_COEFFICIENTS[-1])
    for c in reversed(ERFC_COEFFICIENTS[:-1]):
        poly = poly * t + F.lit(c)
    return t * F.exp(-a * a + poly)


def log_factorial(n: Column | str) -> Column:
    """``ln(n!)``: exact table below 16, Stirling's series (error below 1e-12) above."""
    n = col(n).cast("double")
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = n + 1.0
    inv = 1.0 / x
    series = inv / 12.0 - inv * inv * inv / 360.0 + F.pow(inv, F.lit(5.0)) / 1260.0
    big = (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + series
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise(big)


def log_choose(n: Column | str, k: Column | str) -> Column:
    n, k = col(n), col(k)
    return log_factorial(n) - log_factorial(k) - log_factorial(n - k)


def _reach(centre: Column, k: Column, top: Column) -> Column:
    """Last term of an upper tail worth adding: 40 standard deviations past the mean or past ``k``."""
    return F.least(top, (F.greatest(k.cast("double"), centre) + 40.0 * F.sqrt(centre) + 50.0).cast("bigint"))


def binomial_upper_tail(k: Column, n: Column, p: Column) -> Column:
    """``P(X >= k)`` for Binomial(n, p), summed in log space over the terms that carry weight."""
    mean = n * p
    first = F.greatest(k, (mean - 40.0 * F.sqrt(mean) - 50.0).cast("bigint"))

    def term(i: Column) -> Column:
        return F.exp(log_choose(n, i) + i * F.log(p) + (n - i) * F.log1p(-p))

    tail = F.aggregate(F.sequence(first, _reach(mean, first, n)), F.lit(0.0), lambda acc, i: acc + term(i))
    return (F.when(k <= 0, F.lit(1.0)).when(p <= 0, F.lit(0.0)).when(p >= 1, F.lit(1.0))
            .otherwise(F.least(F.lit(1.0), tail)))


def hypergeometric_upper_tail(k: Column, drawn: Column, good: Column, total: Column) -> Column:
    """``P(X >= k)`` when ``drawn`` of ``total`` are taken and ``good`` of them are marked."""
    denom = log_choose(total, drawn)
    mean = drawn * good / total
    top = F.least(drawn, good)
    first = F.greatest(k, drawn + good - total, (mean - 40.0 * F.sqrt(mean) - 50.0).cast("bigint"))

    def term(i: Column) -> Column:
        return F.exp(log_choose(good, i) + log_choose(total - good, drawn - i) - denom)

    tail = F.aggregate(F.sequence(first, _reach(mean, first, top)), F.lit(0.0), lambda acc, i: acc + term(i))
    return F.when(k <= 0, F.lit(1.0)).when(k > top, F.lit(0.0)).otherwise(F.least(F.lit(1.0), tail))


def stars(p: Column | str) -> Column:
    """Significance stars at .05, .01 and .001."""
    p = col(p)
    return (F.when(p.isNull(), "").when(p < 0.001, "***").when(p < 0.01, "**")
            .when(p < 0.05, "*").otherwise(""))


def first_number(c: Column | str) -> Column:
    """The first number inside a label such as ``D14``; NULL when there is none."""
    text = F.regexp_extract(col(c).cast("string"), r"(\d+\.?\d*)", 1)
    return F.when(text != "", text.try_cast("double"))


def natural_key(c: Column | str) -> Column:
    """A sortable text key: case folded, digit runs left-padded to 20 places."""
    low = F.lower(col(c).cast("string"))
    padded = F.regexp_replace(low, r"(\d+)", "00000000000000000000$1")
    return F.regexp_replace(padded, r"0*(\d{20})(?!\d)", "$1")
