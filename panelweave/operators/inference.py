"""Regressions with autocorrelation-robust errors, resampling nulls and bootstraps. Sums are distributed; only k x k systems, one
row per group, are solved in numpy. A simulation, window or model is a group key, so nothing loops on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, corr_from_sums, ratio
from panelweave.operators.metrics import sharpe

PRIME = 2147483647

#: Alphas of exact fits are rounding within this.
EXACT = 1e-15
#: So is a sum of squares under this share of those that it was left from.
ROUNDING = 1e-24


def scramble(a: Column, b: Column) -> Column:
    """A number below 2**31 - 1 from two integers: the seedless stand-in for a random draw, the same on every engine."""
    h = ((a * 1009 + b * 9176 + 12345) * 48271) % PRIME
    return (h * h + 31 * h) % PRIME * 69621 % PRIME


def bartlett_sum(x: str, lags: int, keys: list[str], order: str = "date") -> tuple[list[Column], Column]:
    """Columns for the products of x with its lags (to be selected first), and the Newey-West sum over them (to be aggregated)."""
    w = Window.partitionBy(*keys).orderBy(order)
    products = [(F.col(x) * F.col(x)).alias("_c0"), *[(F.col(x) * F.lag(x, k).over(w)).alias(f"_c{k}") for k in range(1, lags + 1)]]
    weights = [1.0, *[2 * (1 - k / (lags + 1)) for k in range(1, lags + 1)]]
    return products, sum((F.coalesce(F.sum(f"_c{k}"), F.lit(0.0)) * v for k, v in enumerate(weights)), F.lit(0.0))


def nw_ols(rows: DataFrame, keys: list[str], y: str, xs: list[str], lags: int, order: str = "date") -> DataFrame:
    """(keys, n, r2, term, coef, t): OLS of y on a constant and xs per group, with Newey-West (Bartlett) t values.

    Rows with a null in y or xs don't count; terms of a singular system are null, and so is t where the fit is exact: what it would divide by is rounding. First pass: the cross products' sums per group, then a
    k x k inverse for one row per group. Second pass: each row's influence on each coefficient, whose lagged products give the variance.
    """
    names = ["const", *xs]
    cols = [F.lit(1.0), *[F.col(x) for x in xs]]
    k = len(cols)
    rows = rows.dropna(subset=[y, *xs]).select(*keys, order, F.col(y).alias("_y"), F.array(*cols).alias("_x"))
    at = lambda c, i: F.element_at(c, i + 1)
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.var_pop("_y").alias("_vy"),
        F.array(*[F.sum(at("_x", i) * at("_x", j)) for i in range(k) for j in range(k)]).alias("_xx"), F.array(*[F.sum(at("_x", i) * F.col("_y")) for i in range(k)]).alias("_xy"),
    )

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            inverse, coef = [], []
            for xx, xy in zip(pdf["_xx"], pdf["_xy"], strict=True):
                m = np.asarray(xx, dtype=float).reshape(k, k)
                scale = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
                corr = m / np.outer(scale, scale)
                good = np.linalg.matrix_rank(corr, tol=1e-10) == k
                inv = np.linalg.inv(corr) / np.outer(scale, scale) if good else np.full((k, k), np.nan)
                inverse.append(inv.ravel() if good else None)
                coef.append(inv @ np.asarray(xy, dtype=float) if good else None)
            yield pdf.drop(columns=["_xx", "_xy"]).assign(_inv=inverse, _b=coef)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    fit = sums.mapInPandas(solve, ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", n long, _vy double, _inv array<double>, _b array<double>")
    u = F.col("_y") - sum((at("_b", i) * at("_x", i) for i in range(1, k)), at("_b", 0))
    rows = rows.join(fit, keys).withColumn("_u", u)
    terms = [F.struct(F.lit(names[i]).alias("term"), at("_b", i).alias("coef"), (F.col("_u") * sum((at("_inv", i * k + j) * at("_x", j) for j in range(1, k)), at("_inv", i * k))).alias("_g")) for i in range(k)]
    each = rows.select(*keys, order, "n", "_vy", "_y", "_u", F.inline(F.array(*terms)))
    products, variance = bartlett_sum("_g", lags, [*keys, "term"], order)
    squares = lambda c: F.sum(F.col(c) * F.col(c))
    out = each.select(*keys, "term", "coef", "n", "_vy", "_y", "_u", *products).groupBy(*keys, "term").agg(
        F.first("n").alias("n"), F.first("coef").alias("coef"), (1 - ratio(squares("_u"), F.first("_vy") * F.first("n"))).alias("r2"), F.when(squares("_u") > ROUNDING * squares("_y"), F.greatest(variance, F.lit(0.0))).alias("_v")
    )
    return out.select(*keys, "n", "r2", "term", "coef", ratio(F.col("coef"), F.sqrt("_v")).alias("t"))


def windows(rows: DataFrame, keys: list[str], size: int, step: int, order: str = "date") -> DataFrame:
    """Each row once for every full window of `size` rows, begun every `step` rows, that holds it; `start` is the window's first row number."""
    w = Window.partitionBy(*keys)
    rows = rows.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    low = F.greatest(F.lit(0), F.ceil((F.col("_i") - size + 1) / step)).cast("int")
    high = F.least(F.floor(F.col("_i") / step), F.floor((F.col("_n") - size) / step)).cast("int")
    rows = rows.withColumn("_lo", low).withColumn("_hi", high).where("_lo <= _hi")
    return rows.withColumn("_k", F.explode(F.sequence("_lo", "_hi"))).withColumn("start", F.col("_k") * step).drop("_i", "_n", "_lo", "_hi", "_k")


def attribution(rows: DataFrame, y: str, models: dict[str, list[str]], lags: int, gross: DataFrame, cash: str, periods: dict[str, tuple[str, str]], per_year: int, least: int = 30, spread: float = 0.005) -> DataFrame:
    """(book, model, part, n, r2, term, coef, t, alpha, stressed): each book's return over cash under each model on the whole span, on either half and in each period (name: first and last date).

    gross: (book, gross), the mean gross exposure. alpha is the constant a year, and stressed what is left of it if what is held above one is borrowed at cash and a spread; both are null for other terms. A row counts only if no
    model misses a factor, so that all models see the same rows, and a part only from `least` rows on. Models and periods are a handful.
    """
    rows = rows.dropna(subset=sorted({y, cash, *(x for xs in models.values() for x in xs)})).withColumn("_over", F.col(y) - F.col(cash))
    half = F.col("_i") <= F.floor(F.col("_n") / 2)
    rows = rows.withColumn("_i", F.row_number().over(by("book"))).withColumn("_n", F.count("*").over(Window.partitionBy("book")))
    within = [F.when(F.col("date").between(F.lit(start).cast("date"), F.lit(stop).cast("date")), F.lit(name)) for name, (start, stop) in periods.items()]
    rows = rows.withColumn("part", F.explode(F.array_compact(F.array(F.lit("all"), F.when(half, "first").otherwise("second"), *within))))
    fits = [nw_ols(rows, ["book", "part"], "_over", xs, lags).withColumn("model", F.lit(name)) for name, xs in models.items()]
    out = fits[0]
    for f in fits[1:]:
        out = out.unionByName(f)
    cost = rows.groupBy("book", "part").agg((F.avg(cash) * per_year + spread).alias("_cost")).join(gross, "book").select("book", "part", (F.greatest(F.col("gross") - 1, F.lit(0.0)) * F.col("_cost")).alias("_cost"))
    alpha = F.when(F.col("term") == "const", F.col("coef") * per_year)
    return out.where(F.col("n") >= least).join(cost, ["book", "part"]).withColumn("alpha", alpha).withColumn("stressed", F.col("alpha") - F.col("_cost")).drop("_cost")


def timing_gate(rows: DataFrame, y: str, x: str, lags: int) -> DataFrame:
    """Per book: beta, gamma (on the squared market), its t under two lag choices, the least effect that would show, and a verdict."""
    rows = rows.withColumn("x_sq", F.col(x) * F.col(x))
    pick = lambda lag_n, s: nw_ols(rows, ["book"], y, [x, "x_sq"], lag_n).groupBy("book").agg(F.first("n").alias(f"n{s}"), F.max(F.when(F.col("term") == x, F.col("coef"))).alias(f"beta{s}"), F.max(F.when(F.col("term") == "x_sq", F.col("coef"))).alias(f"gamma{s}"), F.max(F.when(F.col("term") == "x_sq", F.col("t"))).alias(f"t{s}"))
    g = pick(lags, "").join(pick(4 * lags, "_long").select("book", "t_long"), "book")
    g = g.withColumn("least_effect", 2.8 * F.abs(ratio(F.col("gamma"), F.col("t"))))
    verdict = F.when((F.col("t") > 2) & (F.col("t_long") > 2), "TIMES").when((F.col("t") < -2) & (F.col("t_long") < -2), "ANTI").otherwise("NONE")
    return g.withColumn("verdict", verdict)


def one_sample(nets: DataFrame) -> DataFrame:
    """Per book: n, mean, t, share above zero and the sign test's z."""
    x = F.col("net")
    n, up = F.count_if(x != 0).cast("double"), F.count_if(x > 0).cast("double")
    return nets.groupBy("book").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), ratio(F.avg(x) * F.sqrt(F.count(x).cast("double")), F.stddev_samp(x)).alias("t"), F.avg((x > 0).cast("double")).alias("share"), ratio(2 * up - n, F.sqrt(n)).alias("sign_z"))


def forward_descriptive(rows: DataFrame, lags: int, least: int, per_year: int) -> DataFrame:
    """Per book: n, growth, tracking error against `bench`, share of positive months, mean difference and its robust t from `least` rows on; null where the difference never varies by more than rounding."""
    rows = rows.withColumn("_d", F.col("net") - F.col("bench"))
    months = rows.groupBy("book", F.date_trunc("month", "date").alias("_m")).agg(F.sum(F.log1p("net")).alias("_l")).groupBy("book").agg(F.avg((F.col("_l") > 0).cast("double")).alias("months_up"))
    rows = rows.withColumn("_e", F.col("_d") - F.avg("_d").over(Window.partitionBy("book")))
    products, variance = bartlett_sum("_e", lags, ["book"])
    varies = F.sum(F.col("_e") * F.col("_e")) > ROUNDING * F.sum(F.col("net") * F.col("net") + F.col("bench") * F.col("bench"))
    g = rows.select("book", "net", "bench", "_d", "_e", *products).groupBy("book").agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p("net"))) - 1).alias("growth"), (F.stddev_samp("_d") * F.sqrt(F.lit(float(per_year)))).alias("tracking"), F.avg("_d").alias("mean_gap"), F.when(varies, F.greatest(variance, F.lit(0.0))).alias("_v"))
    return g.join(months, "book").select("book", "n", "growth", "tracking", "months_up", "mean_gap", F.when(F.col("n") >= least, ratio(F.col("mean_gap") * F.col("n"), F.sqrt("_v"))).alias("t"))


def positions(rows: DataFrame, keys: list[str]) -> DataFrame:
    """pos from 0 in date order and n, the number of rows, per group."""
    w = Window.partitionBy(*keys)
    return rows.withColumn("pos", (F.row_number().over(w.orderBy("date")) - 1).cast("long")).withColumn("n", F.count("*").over(w))


def block_draws(sizes: DataFrame, keys: list[str], sims: int, block: int) -> DataFrame:
    """(keys, sim, at, pos): for each simulation the source row of each row, from circular blocks with scrambled starts."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    x = sizes.select(*keys, "n", upto(F.lit(sims - 1).cast("long")).alias("sim")).select("*", upto((F.ceil(F.col("n") / block) - 1).cast("long")).alias("b"))
    x = x.withColumn("_s", scramble(F.col("sim"), F.col("b")) % F.col("n")).select("*", upto(F.lit(block - 1).cast("long")).alias("k"))
    x = x.withColumn("at", F.col("b") * block + F.col("k")).where("at < n")
    return x.select(*keys, "sim", "at", ((F.col("_s") + F.col("k")) % F.col("n")).alias("pos"))


def stationary_draws(sizes: DataFrame, keys: list[str], sims: int, mean_block: int) -> DataFrame:
    """(keys, sim, at, pos): blocks of geometric length, restarted where the scrambled number is a multiple of the mean length."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n))
    x = sizes.select(*keys, "n", upto(F.lit(sims - 1).cast("long")).alias("sim")).select("*", upto((F.col("n") - 1).cast("long")).alias("at"))
    x = x.withColumn("_h", scramble(F.col("sim"), F.col("at")))
    x = x.withColumn("_r", F.when((F.col("at") == 0) | (F.col("_h") % mean_block == 0), F.struct("at", F.floor(F.col("_h") / mean_block).alias("s"))))
    last = F.last("_r", ignorenulls=True).over(Window.partitionBy(*keys, "sim").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_l", last).select(*keys, "sim", "at", ((F.col("_l.s") + F.col("at") - F.col("_l.at")) % F.col("n")).cast("long").alias("pos"))


def paired_bootstrap(pairs: DataFrame, sims: int, block: int, per_year: int) -> DataFrame:
    """Difference of the sharpes of x and y (equal volatility) over block resamples of their common dates: quantiles and share above zero."""
    s = positions(pairs, ["pair"])
    x = block_draws(s.select("pair", "n").distinct(), ["pair"], sims, block).join(s.select("pair", "pos", "x", "y"), ["pair", "pos"])
    each = x.groupBy("pair", "sim").agg((sharpe("x", per_year) - sharpe("y", per_year)).alias("d"))
    return each.groupBy("pair").agg(F.percentile("d", F.lit(0.05)).alias("p05"), F.percentile("d", F.lit(0.5)).alias("p50"), F.percentile("d", F.lit(0.95)).alias("p95"), F.avg((F.col("d") > 0).cast("double")).alias("share"))


def stationary_bootstrap(nets: DataFrame, sims: int, mean_block: int) -> DataFrame:
    """Quantiles of each book's mean over stationary resamples."""
    s = positions(nets, ["book"])
    x = stationary_draws(s.select("book", "n").distinct(), ["book"], sims, mean_block).join(s.select("book", "pos", "net"), ["book", "pos"])
    each = x.groupBy("book", "sim").agg(F.avg("net").alias("m"))
    return each.groupBy("book").agg(F.percentile("m", F.lit(0.05)).alias("p05"), F.percentile("m", F.lit(0.5)).alias("p50"), F.percentile("m", F.lit(0.95)).alias("p95"))


def alpha_block_interval(rows: DataFrame, sims: int, block: int) -> DataFrame:
    """Quantiles of the intercept of net on m over block resamples."""
    s = positions(rows.dropna(subset=["net", "m"]), ["book"])
    x = block_draws(s.select("book", "n").distinct(), ["book"], sims, block).join(s.select("book", "pos", "net", "m"), ["book", "pos"])
    each = x.groupBy("book", "sim").agg((F.avg("net") - ratio(F.covar_pop("net", "m"), F.var_pop("m")) * F.avg("m")).alias("a"))
    return each.groupBy("book").agg(F.percentile("a", F.lit(0.05)).alias("p05"), F.percentile("a", F.lit(0.5)).alias("p50"), F.percentile("a", F.lit(0.95)).alias("p95"))


def placebo_signals(rows: DataFrame, sims: int, per_year: int) -> DataFrame:
    """A gate against its own circular shifts: the gated series' sharpe, the placebos' 95th percentile and the share of placebos below.

    rows: (book, date, net, gate). Each placebo applies the same gate, moved by a scrambled number of rows, so its run lengths match.
    """
    s = positions(rows, ["book"])
    shifts = s.select("book", "n").distinct().select("book", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(sims).cast("long"))).alias("sim"), "n").withColumn("shift", scramble(F.col("sim"), F.lit(7).cast("long")) % F.col("n"))
    moved = shifts.join(s.select("book", "pos", "gate"), "book").select("book", "sim", ((F.col("pos") + F.col("shift")) % F.col("n")).alias("pos"), F.col("gate").alias("g"))
    sims_ = s.select("book", "pos", "net").join(moved, ["book", "pos"]).groupBy("book", "sim").agg(sharpe(F.col("net") * F.col("g"), per_year).alias("sr"))
    real = s.groupBy("book").agg(sharpe(F.col("net") * F.col("gate"), per_year).alias("actual"))
    return sims_.join(real, "book").groupBy("book").agg(F.first("actual").alias("actual"), F.percentile("sr", F.lit(0.95)).alias("p95"), F.avg((F.col("sr") < F.col("actual")).cast("double")).alias("share_below"))


def permutation_null(rows: DataFrame, sims: int, x: str = "x", y: str = "y") -> DataFrame:
    """Per ticker: correlation of x and y, and the share of order-scrambled copies of y whose correlation is at least as large in size."""
    s = positions(rows.dropna(subset=[x, y]), ["ticker"])
    draw = s.select("ticker", "pos", F.col(y).alias("v"), F.explode(F.sequence(F.lit(1).cast("long"), F.lit(sims).cast("long"))).alias("sim"))
    order = Window.partitionBy("ticker", "sim").orderBy(scramble(F.col("sim"), F.col("pos")), "pos")
    draw = draw.withColumn("at", (F.row_number().over(order) - 1).cast("long")).select("ticker", "sim", F.col("at").alias("pos"), "v")
    null = draw.join(s.select("ticker", "pos", F.col(x).alias("u")), ["ticker", "pos"]).groupBy("ticker", "sim").agg(corr_from_sums(F.col("u"), F.col("v")).alias("c"))
    real = s.groupBy("ticker").agg(F.count("*").alias("n"), corr_from_sums(F.col(x), F.col(y)).alias("corr"))
    return null.join(real, "ticker").groupBy("ticker").agg(F.first("n").alias("n"), F.first("corr").alias("corr"), F.avg((F.abs("c") >= F.abs("corr") - 1e-9).cast("double")).alias("p"))


def sign_flip(alphas: DataFrame, keys: list[str], sims: int) -> DataFrame:
    """(keys, windows, mean, t, share_up, share, p): per key the windows' mean alpha, its t, the share above zero and the larger share on one side, and the share of sign patterns whose mean is at least as large in size.

    alphas: (keys, pos, alpha). A pattern is one scrambled bit per window number, so all keys share the patterns. For t, the shares, and between means, what is within EXACT is none.
    """
    w = Window.partitionBy(*keys)
    part = lambda c: F.avg(c.cast("double")).over(w)
    mean, n, sd = F.avg("alpha").over(w), F.count("*").over(w), F.stddev_samp("alpha").over(w)
    stats = F.struct(
        n.alias("windows"), mean.alias("mean"), ratio(mean * F.sqrt(n.cast("double")), F.when(sd > EXACT, sd)).alias("t"),
        part(F.col("alpha") > EXACT).alias("share_up"), F.greatest(part(F.col("alpha") > EXACT), part(F.col("alpha") < -EXACT)).alias("share"),
    )
    x = alphas.select(*keys, "alpha", "pos", stats.alias("_s")).withColumn("sim", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(sims).cast("long"))))
    sign = F.when(F.floor(scramble(F.col("sim"), F.col("pos")) / 1024) % 2 == 0, 1.0).otherwise(-1.0)
    null = x.groupBy(*keys, "sim").agg(F.avg(F.col("alpha") * sign).alias("m"), F.first("_s").alias("_s"))
    return null.groupBy(*keys).agg(F.first("_s").alias("_s"), F.avg((F.abs("m") >= F.abs("_s.mean") - EXACT).cast("double")).alias("p")).select(*keys, "_s.*", "p")


def cluster_ols(rows: DataFrame, key: str, cluster: str, y: str = "y", x: str = "x") -> DataFrame:
    """Per key: slope of y on x, its cluster-robust (CR1) t, the clusters' number, and the least and largest slope with one cluster left out."""
    rows = rows.dropna(subset=[y, x]).select(key, cluster, F.col(y).alias("_y"), F.col(x).alias("_x"))
    part = rows.groupBy(key, cluster).agg(F.count("*").alias("n"), F.sum("_x").alias("x"), F.sum("_y").alias("y"), F.sum(F.col("_x") * F.col("_y")).alias("xy"), F.sum(F.col("_x") * F.col("_x")).alias("xx"))
    w = Window.partitionBy(key)
    for c in ("n", "x", "y", "xy", "xx"):
        part = part.withColumn(f"t_{c}", F.sum(c).over(w))
    slope = lambda n, sx, sy, sxy, sxx: ratio(sxy - sx * sy / n, sxx - sx * sx / n)
    t, rest = ([F.col(f"t_{c}") for c in ("n", "x", "y", "xy", "xx")], [F.col(f"t_{c}") - F.col(c) for c in ("n", "x", "y", "xy", "xx")])
    part = part.withColumn("b", slope(*t)).withColumn("a", (F.col("t_y") - F.col("b") * F.col("t_x")) / F.col("t_n")).withColumn("without", F.when(rest[0] > 0, slope(*rest)))
    mx = F.col("t_x") / F.col("t_n")
    score = (F.col("xy") - F.col("a") * F.col("x") - F.col("b") * F.col("xx")) - mx * (F.col("y") - F.col("a") * F.col("n") - F.col("b") * F.col("x"))
    g = part.withColumn("_s", score).groupBy(key).agg(F.first("t_n").alias("n"), F.count("*").alias("clusters"), F.first("b").alias("slope"), F.sum(F.col("_s") * F.col("_s")).alias("_m"), F.first(F.col("t_xx") - F.col("t_x") * mx).alias("_d"), F.min("without").alias("least"), F.max("without").alias("most"))
    c, n = F.col("clusters").cast("double"), F.col("n").cast("double")
    se = F.sqrt(ratio(c, c - 1) * ratio(n - 1, n - 2) * F.col("_m")) / F.col("_d")
    return g.select(key, "n", "clusters", "slope", ratio(F.col("slope"), se).alias("t"), "least", "most")
