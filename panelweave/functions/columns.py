"""Column expressions that the operators share. Missing is null; nothing here leaves the JVM."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by(*keys: str, order: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order)


def trailing(n: int, *keys: str, order: str = "date") -> WindowSpec:
    """The current row and the n - 1 before it."""
    return by(*keys, order=order).rowsBetween(-(n - 1), 0)


def full(agg: Column, x: Column, window: WindowSpec, n: int) -> Column:
    """A window aggregate that is null unless n values are present."""
    return F.when(F.count(x).over(window) == n, agg.over(window))


def rolling_mean(x: str | Column, n: int, *keys: str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return full(F.avg(x), x, trailing(n, *keys), n)


def rolling_std(x: str | Column, n: int, *keys: str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return full(F.stddev_samp(x), x, trailing(n, *keys), n)


def rolling_sum(x: str | Column, n: int, *keys: str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return full(F.sum(x), x, trailing(n, *keys), n)


def rolling_median(x: str | Column, n: int, *keys: str) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return full(F.percentile(x, F.lit(0.5)), x, trailing(n, *keys), n)


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero."""
    return F.try_divide(a, b)


def nearest(x: Column) -> Column:
    """x as a whole double, halves away from zero: F.round's result, which that one takes from a row's decimal digits at several times the cost."""
    whole = F.rint(x)
    return F.when(F.abs(x - whole) == 0.5, x + F.signum(x) / 2).otherwise(whole)


def clip(x: Column, low: float | None, high: float | None) -> Column:
    """x within bounds; null stays null, unlike with greatest and least alone."""
    y = x if low is None else F.greatest(x, F.lit(low))
    return F.when(x.isNotNull(), y if high is None else F.least(y, F.lit(high)))


def average_rank(x: str, *keys: str) -> Column:
    """Rank from 1, ties sharing their mean rank; null for null."""
    order = Window.partitionBy(*keys, F.col(x).isNull()).orderBy(x)
    tie = Window.partitionBy(*keys, x)
    return F.when(F.col(x).isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(tie) - 1) / 2)


def corr_from_sums(x: Column, y: Column) -> Column:
    """Pearson correlation of pairs where both are present; null for a constant side."""
    ok = x.isNotNull() & y.isNotNull()
    a, b = F.when(ok, x), F.when(ok, y)
    vx, vy = F.var_pop(a), F.var_pop(b)
    return F.when((vx > 1e-18) & (vy > 1e-18), F.covar_pop(a, b) / F.sqrt(vx * vy))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded for comparison between engines; no negative zero."""
    return df.select(*[(F.round(F.col(c), places) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def norm_cdf(z: Column, steps: int = 128) -> Column:
    """The standard normal distribution function by Simpson's rule from 0; beyond 8 deviations it is 0 or 1."""
    end = clip(z, -8.0, 8.0)
    weight = lambda i: F.when((i == 0) | (i == steps), 1.0).when(i % 2 == 1, 4.0).otherwise(2.0)
    area = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.lit(0.0), lambda s, i: s + weight(i) * F.exp(-F.pow(end * i / steps, F.lit(2)) / 2))
    return F.lit(0.5) + area * end / (3 * steps * (2 * math.pi) ** 0.5)


def norm_ppf(p: float) -> float:
    """The quantile of a constant."""
    return NormalDist().inv_cdf(p)


#: Lanczos' approximation of the gamma function, g = 7.
_LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905,
    -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def ln_gamma(x: Column) -> Column:
    """Logarithm of the gamma function from one half on."""
    series = sum((F.lit(c) / (x - 1 + i) for i, c in enumerate(_LANCZOS) if i), F.lit(_LANCZOS[0]))
    return F.lit(0.5 * math.log(2 * math.pi)) + (x - 0.5) * F.log(x + 6.5) - (x + 6.5) + F.log(series)


def beta_inc(a: Column, b: Column, x: Column, steps: int = 200) -> Column:
    """The regularised incomplete beta function by its continued fraction, 0 and 1 beyond the ends; null for null."""
    tiny = 1e-300
    kept = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)

    def fraction(a: Column, b: Column, x: Column) -> Column:
        first = 1 / kept(1 - (a + b) * x / (a + 1))

        def both(s: Column, i: Column) -> Column:
            m = i.cast("double")
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            d = 1 / kept(1 + even * s["d"])
            c = kept(1 + even / s["c"])
            d2 = 1 / kept(1 + odd * d)
            c2 = kept(1 + odd / c)
            return F.struct(c2.alias("c"), d2.alias("d"), (s["h"] * d * c * d2 * c2).alias("h"))

        start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
        front = F.exp(ln_gamma(a + b) - ln_gamma(a) - ln_gamma(b) + a * F.log(x) + b * F.log(1 - x)) / a
        return front * F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, both, lambda s: s["h"])

    inside = F.when(x < (a + 1) / (a + b + 2), fraction(a, b, x)).otherwise(1 - fraction(b, a, 1 - x))
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x.isNotNull() & a.isNotNull() & b.isNotNull(), inside)


def t_p(t: Column, dof: Column) -> Column:
    """Two-sided probability of Student's t."""
    dof = dof.cast("double")
    return F.when(dof > 0, beta_inc(dof / 2, F.lit(0.5), dof / (dof + t * t)))


def f_p(value: Column, above: Column, below: Column) -> Column:
    """Upper-tail probability of the F distribution with `above` and `below` degrees of freedom."""
    above, below = above.cast("double"), below.cast("double")
    return F.when((above > 0) & (below > 0), beta_inc(below / 2, above / 2, below / (below + above * value)))


def paired_t(x: str | Column) -> tuple[Column, Column]:
    """Aggregates: the t value of a mean of differences (null below two, or where they don't vary), and its degrees of freedom."""
    x = F.col(x) if isinstance(x, str) else x
    n = F.count(x)
    sd = F.stddev_samp(x)
    return F.when((n > 1) & (sd > 1e-15), F.avg(x) / (sd / F.sqrt(n.cast("double")))), n - 1
