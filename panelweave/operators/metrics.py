"""Performance and selection statistics per book."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DoubleType, IntegerType, StringType, StructField, StructType

from panelweave.functions.columns import by, clip, corr_from_sums, norm_cdf, norm_ppf, ratio, rolling_mean, rolling_std
from panelweave.operators import state as P
from panelweave.operators.rolling import drawdown


def sharpe(x: str | Column = "net", per_year: int = 252) -> Column:
    """Zero with fewer than two values or no dispersion."""
    x = F.col(x) if isinstance(x, str) else x
    sd = F.stddev_samp(x)
    return F.when((F.count(x) < 2) | (F.coalesce(sd, F.lit(0.0)) <= 1e-18), 0.0).otherwise(ratio(F.avg(x), sd) * F.sqrt(F.lit(float(per_year))))


def scorecard(nets: DataFrame, per_year: int = 252) -> DataFrame:
    """Per book: n, sharpe, hit rate, worst drawdown, growth a year, volatility, turnover, cost, and the sharpe of each half."""
    d = drawdown(nets, "net", "book").withColumn("_i", F.row_number().over(by("book"))).withColumn("_n", F.count("*").over(Window.partitionBy("book")))
    first = F.col("_i") <= F.floor(F.col("_n") / 2)
    return d.groupBy("book").agg(
        F.count("net").alias("n"), sharpe("net", per_year).alias("sharpe"), F.avg((F.col("net") > 0).cast("double")).alias("hit"), F.min("dd").alias("max_dd"), (F.exp(F.sum(F.log1p("net")) * per_year / F.count("net")) - 1).alias("cagr"), (F.stddev_samp("net") * F.sqrt(F.lit(float(per_year)))).alias("vol"),
        F.avg("turnover").alias("turnover"), F.sum("cost").alias("cost"), sharpe(F.when(first, F.col("net")), per_year).alias("sharpe_1"), sharpe(F.when(~first, F.col("net")), per_year).alias("sharpe_2"),
    )


def moments(nets: DataFrame) -> DataFrame:
    """n, mean, sd and the biased third and fourth standardised moments, from power sums."""
    x = F.col("net")
    s = nets.groupBy("book").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.var_pop(x).alias("m2"), F.avg(x * x).alias("p2"), F.avg(x * x * x).alias("p3"), F.avg(x * x * x * x).alias("p4"))
    m3 = F.col("p3") - 3 * F.col("mean") * F.col("p2") + 2 * F.pow("mean", F.lit(3))
    m4 = F.col("p4") - 4 * F.col("mean") * F.col("p3") + 6 * F.col("mean") * F.col("mean") * F.col("p2") - 3 * F.pow("mean", F.lit(4))
    return s.select("book", "n", "mean", "sd", ratio(m3, F.pow("m2", F.lit(1.5))).alias("skew"), ratio(m4, F.col("m2") * F.col("m2")).alias("kurt"))


def deflated_z(nets: DataFrame, luck: float) -> DataFrame:
    """z of the per-period sharpe against the bar that luck sets, with skew and kurtosis; its normal cdf is the deflated probability."""
    m = moments(nets).withColumn("sr", ratio(F.col("mean"), F.col("sd")))
    var = 1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")
    return m.select("book", "n", "sr", "skew", "kurt", ratio((F.col("sr") - luck) * F.sqrt((F.col("n") - 1).cast("double")), F.sqrt(var)).alias("z"))


def luck(n_trials: int) -> float:
    """The expected best of so many sharpes without skill, in units of their dispersion."""
    if n_trials <= 1:
        return 0.0
    gamma = 0.5772156649015329  # Euler's constant
    return (1 - gamma) * norm_ppf(1 - 1 / n_trials) + gamma * norm_ppf(1 - 1 / (n_trials * math.e))


def deflated_sharpe(nets: DataFrame, n_trials: int, least: int = 10) -> DataFrame:
    """(book, n, sr, bar, p, bar_trials, p_trials): the probability that the true sharpe beats luck over n_trials tries, whose dispersion is 1 / sqrt(n - 1), and, in the
    second form, that of the books' own sharpes. Zero with fewer than `least` values."""
    m = moments(nets).withColumn("sr", ratio(F.col("mean"), F.col("sd")))
    spread = m.agg(F.stddev_samp("sr").alias("_spread"))
    m = m.crossJoin(F.broadcast(spread))  # one row
    root = F.sqrt((F.col("n") - 1).cast("double"))
    bars = {"bar": F.lit(luck(n_trials)) / root, "bar_trials": F.lit(luck(n_trials)) * F.coalesce("_spread", F.lit(0.0))}
    below = F.sqrt(F.greatest(1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr"), F.lit(1e-12)))
    p = lambda bar: F.when(F.col("n") >= least, F.coalesce(norm_cdf((F.col("sr") - bar) * root / below), F.lit(0.0))).otherwise(0.0)
    return m.select("book", "n", "sr", bars["bar"].alias("bar"), p(bars["bar"]).alias("p"), bars["bar_trials"].alias("bar_trials"), p(bars["bar_trials"]).alias("p_trials"))


def autocorr_inflation(nets: DataFrame, lags: int) -> DataFrame:
    """1 + 2 * sum of (1 - k / n) rho_k per book."""
    m = Window.partitionBy("book")
    x = nets.withColumn("_d", F.col("net") - F.avg("net").over(m))
    s = x.select("book", "_d", *[(F.col("_d") * F.lag("_d", k).over(by("book"))).alias(f"_c{k}") for k in range(1, lags + 1)], "date")
    g = s.groupBy("book").agg(F.count("*").alias("n"), F.sum(F.col("_d") * F.col("_d")).alias("v"), *[F.sum(f"_c{k}").alias(f"c{k}") for k in range(1, lags + 1)])
    total = sum((2 * (1 - F.lit(float(k)) / F.col("n")) * ratio(F.col(f"c{k}"), F.col("v")) for k in range(1, lags + 1)), F.lit(1.0))
    return g.select("book", "n", total.alias("inflation"))


def regime_table(nets: DataFrame, regimes: DataFrame) -> DataFrame:
    """Days, log return and sharpe of each book in each lagged regime."""
    r = regimes.withColumn("regime", F.lag("regime").over(Window.orderBy("date")))
    return nets.join(r, "date").where("regime is not null").groupBy("book", "regime").agg(F.count("*").alias("days"), F.sum(F.log1p("net")).alias("log_net"), sharpe("net", 52).alias("sharpe"))


def episodes(series: DataFrame, level: float, gap: int) -> DataFrame:
    """Stretches of rows at or above the level; stretches less than `gap` rows apart are one."""
    s = series.withColumn("_i", F.row_number().over(Window.orderBy("date"))).where(F.col("v") >= level)
    w = Window.orderBy("date")
    s = s.withColumn("_new", F.coalesce(F.col("_i") - F.lag("_i").over(w) >= gap, F.lit(True)).cast("int")).withColumn("episode", F.sum("_new").over(w))
    return s.groupBy("episode").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n"), F.max("v").alias("peak"))


def crash_windows(nets: DataFrame, windows: list[tuple[str, str, str]]) -> DataFrame:
    """Return of each book over named windows (start excluded, end included); the list is a handful of literals."""
    w = nets.sparkSession.createDataFrame(windows, "name string, start string, end string").select("name", F.to_date("start").alias("start"), F.to_date("end").alias("end"))
    hit = nets.join(F.broadcast(w), (F.col("date") > F.col("start")) & (F.col("date") <= F.col("end")))
    return hit.groupBy("book", "name").agg((F.exp(F.sum(F.log1p("net"))) - 1).alias("ret"), F.count("*").alias("n"))


def paired_t(nets: DataFrame, a: str, b: str) -> DataFrame:
    x, y = (nets.where(F.col("book") == n).select("date", F.col("net").alias(c)) for n, c in ((a, "x"), (b, "y")))
    d = x.join(y, "date").select((F.col("x") - F.col("y")).alias("d"))
    return d.agg(F.count("d").alias("n"), F.avg("d").alias("mean"), ratio(F.avg("d") * F.sqrt(F.count("d").cast("double")), F.stddev_samp("d")).alias("t"), F.avg((F.col("d") > 0).cast("double")).alias("share"))


def nw_mean(nets: DataFrame, lags: int) -> DataFrame:
    """Mean of each book with its Newey-West t (Bartlett weights), from lagged cross products."""
    x = nets.withColumn("_d", F.col("net") - F.avg("net").over(Window.partitionBy("book")))
    s = x.select("book", "net", "_d", *[(F.col("_d") * F.lag("_d", k).over(by("book"))).alias(f"_c{k}") for k in range(1, lags + 1)])
    g = s.groupBy("book").agg(F.count("*").alias("n"), F.avg("net").alias("mean"), F.sum(F.col("_d") * F.col("_d")).alias("c0"), *[F.sum(f"_c{k}").alias(f"c{k}") for k in range(1, lags + 1)])
    var = sum((2 * (1 - F.lit(k / (lags + 1))) * F.col(f"c{k}") for k in range(1, lags + 1)), F.col("c0"))
    return g.select("book", "n", "mean", ratio(F.col("mean") * F.col("n"), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("t"))


def block_bootstrap_sharpe(nets: DataFrame, sims: int, block: int, per_year: int) -> DataFrame:
    """5th, 50th and 95th percentile of the sharpe over circular block resamples; starts come from an integer hash of (sim, block).

    A simulation is a group key: (sim, position) rows are made by a generator and meet the series on (book, position).
    """
    s = nets.withColumn("pos", (F.row_number().over(by("book")) - 1).cast("long")).select("book", "pos", "net")
    size = s.groupBy("book").agg(F.count("*").alias("n"))
    m = 2147483647
    x = size.select("book", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sims - 1).cast("long"))).alias("sim"))
    x = x.select("book", "n", "sim", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / block) - 1)).alias("b"))
    h = ((F.col("sim") * 1009 + F.col("b") * 9176 + 12345) * 48271) % m
    x = x.withColumn("h", h).withColumn("h", (F.col("h") * F.col("h") + 31 * F.col("h")) % m).withColumn("start", (F.col("h") * 69621) % m % F.col("n"))
    x = x.select("book", "n", "sim", "b", "start", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(block - 1).cast("long"))).alias("k")).where(F.col("b") * block + F.col("k") < F.col("n"))
    x = x.withColumn("pos", (F.col("start") + F.col("k")) % F.col("n")).join(s, ["book", "pos"])
    each = x.groupBy("book", "sim").agg(sharpe("net", per_year).alias("sr"))
    q = lambda p: F.percentile("sr", F.lit(p))
    return each.groupBy("book").agg(q(0.05).alias("p05"), q(0.5).alias("p50"), q(0.95).alias("p95"))


def ols_two(nets: DataFrame, x1: str, x2: str) -> DataFrame:
    """Per book: alpha, two betas and R2 of net on two factors, from sums."""
    c = lambda a, b: F.covar_pop(a, b)
    g = nets.dropna(subset=["net", x1, x2]).groupBy("book").agg(
        F.avg("net").alias("my"), F.avg(x1).alias("m1"), F.avg(x2).alias("m2"), F.var_pop(x1).alias("v1"), F.var_pop(x2).alias("v2"), c(x1, x2).alias("c12"), c("net", x1).alias("c1"), c("net", x2).alias("c2"), F.var_pop("net").alias("vy"), F.count("*").alias("n")
    )
    det = F.col("v1") * F.col("v2") - F.col("c12") * F.col("c12")
    g = g.withColumn("b1", ratio(F.col("c1") * F.col("v2") - F.col("c2") * F.col("c12"), det)).withColumn("b2", ratio(F.col("c2") * F.col("v1") - F.col("c1") * F.col("c12"), det))
    return g.select("book", "n", (F.col("my") - F.col("b1") * F.col("m1") - F.col("b2") * F.col("m2")).alias("alpha"), "b1", "b2", ratio(F.col("b1") * F.col("c1") + F.col("b2") * F.col("c2"), F.col("vy")).alias("r2"))


def up_down_beta(nets: DataFrame, x: str = "m") -> DataFrame:
    up = F.col(x) > 0
    part = lambda ok: ratio(F.covar_pop(F.when(ok, F.col("net")), F.when(ok, F.col(x))), F.var_pop(F.when(ok, F.col(x))))
    return nets.dropna(subset=["net", x]).groupBy("book").agg(part(F.lit(True)).alias("beta"), part(up).alias("up"), part(~up).alias("down"))


def shift_null(a: DataFrame, b: DataFrame) -> DataFrame:
    """(shift, r2): squared correlation of a with every circular shift of b; both are one series of (pos from 0, v) of the same length."""
    n = a.agg(F.count("*").alias("n"))
    x = a.crossJoin(F.broadcast(n)).select("pos", F.col("v").alias("x"), "n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n") - 1)).alias("shift"))
    x = x.withColumn("at", (F.col("pos") + F.col("shift")) % F.col("n")).join(b.select(F.col("pos").alias("at"), F.col("v").alias("y")), "at")
    return x.groupBy("shift").agg(ratio(F.pow(F.covar_pop("x", "y"), F.lit(2)), F.var_pop("x") * F.var_pop("y")).alias("r2"))


def vol_clustering(rows: DataFrame, key: str = "ticker") -> DataFrame:
    """Per key: correlation of squared returns with the ones before, and of returns with the change of squared returns that follows."""
    w = by(key)
    x = rows.withColumn("_s", F.col("ret") * F.col("ret")).withColumn("_p", F.lag("_s").over(w)).withColumn("_d", F.lead("_s").over(w) - F.col("_s"))
    return x.groupBy(key).agg(corr_from_sums(F.col("_s"), F.col("_p")).alias("clustering"), corr_from_sums(F.col("ret"), F.col("_d")).alias("leverage"))


def regime_sets(market: DataFrame, index: str = "volx", level: str = "mkt", ret: str = "mkt_ret") -> DataFrame:
    """(date, set, label, market): six ways to label a date by what was known the date before, and the market's return."""
    days = Window.orderBy("date")  # one row per date
    past = days.rowsBetween(Window.unboundedPreceding, 0)
    peak = F.max(level).over(past)
    labels = {
        "index": F.when(F.col(index) > F.avg(index).over(past), "high").otherwise("low"),
        "trend": F.when(F.col(level) > F.avg(level).over(days.rowsBetween(-39, 0)), "above").otherwise("below"),
        "drawdown": F.when(F.col(level) < 0.98 * peak, "deep").when(F.col(level) < peak, "shallow").otherwise("peak"),
        "week": F.when(F.col(ret) > 0, "up").otherwise("down"),
        "quarter": F.concat(F.lit("q"), F.quarter("date").cast("string")),
        "half": F.when(F.col(level) > F.lag(level, 26).over(days), "rising").otherwise("falling"),
    }
    m = market.withColumns({f"_{k}": F.lag(v).over(days) for k, v in labels.items()})
    each = F.array(*[F.struct(F.lit(k).alias("set"), F.col(f"_{k}").alias("label")) for k in labels])
    return m.select("date", F.col(ret).alias("market"), F.explode(each).alias("x")).select("date", "x.*", "market").where("label is not null")


def regime_report(nets: DataFrame, regimes: DataFrame, per_year: int = 52) -> DataFrame:
    """Of each book in each regime of each set: days, log return, that less the market's, sharpe, and its share of the days below the book's peak."""
    d = drawdown(nets, "net", "book").select("book", "date", "net", (F.col("dd") < 0).cast("int").alias("_under"))
    x = d.join(regimes, "date").withColumn("_l", F.log1p("net"))
    g = x.groupBy("book", "set", "label").agg(F.count("*").alias("days"), F.sum("_l").alias("log_net"), F.sum(F.col("_l") - F.log1p(F.coalesce("market", F.lit(0.0)))).alias("relative"), sharpe("net", per_year).alias("sharpe"), F.sum("_under").alias("_u"))
    return g.withColumn("under_share", ratio(F.col("_u").cast("double"), F.sum("_u").over(Window.partitionBy("book", "set")).cast("double"))).drop("_u")


def asset_study(panel: DataFrame, grid: list[tuple[float, int, int]], per_year: int = 52, band: float = 0.01, width: float = 0.1, cap: float = 2.0) -> DataFrame:
    """(ticker, sigma, lookback, sma, variant, n, cagr, sharpe, worst): each asset held, volatility-managed, gated by its average, and both, for each cell of the grid, from the date on which all are known.

    The volatility target moves only beyond the width, a fold over (asset, cell); weights earn on the next date.
    """
    sizes = {n for _, n, _ in grid}
    x = panel.withColumns({f"_v{n}": rolling_std("ret", n, "ticker") * F.sqrt(F.lit(float(per_year))) for n in sizes} | {f"_m{m}": F.col("close") / rolling_mean("close", m, "ticker") - 1 for m in {m for *_, m in grid}})
    cells = F.array(*[F.struct(F.lit(s).alias("sigma"), F.lit(n).alias("lookback"), F.lit(m).alias("sma"), clip(ratio(F.lit(s), F.col(f"_v{n}")), 0.0, cap).alias("target"), F.col(f"_m{m}").alias("above")) for s, n, m in grid])
    x = x.select("ticker", "date", "ret", F.explode(cells).alias("c")).select("ticker", "date", "ret", "c.*")
    keys = ["ticker", "sigma", "lookback", "sma"]

    def step(state: tuple, key: tuple, date: object, rows: list[tuple]) -> tuple[tuple, list[tuple]]:
        held, gate = state
        target, above, ret = rows[0]
        if target is not None and abs(target - held) > width:
            held = target
        if above is not None:
            gate = 1.0 if above > band else 0.0 if above < -band else gate if gate is not None else float(above > 0)
        known = target is not None and gate is not None
        return (held, gate), [(*key, date, ret, held if known else None, gate if known else None)]

    schema = StructType([StructField("ticker", StringType()), StructField("sigma", DoubleType()), StructField("lookback", IntegerType()), StructField("sma", IntegerType()), StructField("date", DateType()), *(StructField(c, DoubleType()) for c in ("ret", "held", "gate"))])
    s = P.fold_days(x, keys, ["target", "above", "ret"], (0.0, None), step, schema)
    w = by(*keys)
    s = s.withColumn("_h", F.lag("held").over(w)).withColumn("_g", F.lag("gate").over(w)).where("_h is not null and _g is not null and ret is not null")
    each = F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("net")) for k, v in {"hold": F.col("ret"), "managed": F.col("_h") * F.col("ret"), "gate": F.col("_g") * F.col("ret"), "both": F.col("_h") * F.col("_g") * F.col("ret")}.items()])
    s = s.select(*keys, "date", F.explode(each).alias("v")).select(*keys, "date", "v.*")
    year = by(*keys, "variant").rowsBetween(-(per_year - 1), 0)
    s = s.withColumn("_y", F.when(F.count("net").over(year) == per_year, F.exp(F.sum(F.log1p("net")).over(year)) - 1))
    return s.groupBy(*keys, "variant").agg(F.count("*").alias("n"), (F.exp(F.sum(F.log1p("net")) * per_year / F.count("*")) - 1).alias("cagr"), sharpe("net", per_year).alias("sharpe"), F.min("_y").alias("worst"))
