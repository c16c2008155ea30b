"""Rolling regressions, residuals and time-series signals; signal space and P&L space are kept apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, full, ratio, rolling_mean, rolling_std, rolling_sum, trailing

ALL = (Window.unboundedPreceding, 0)


def _means(n: int, x: str, y: str, *keys: str) -> tuple[Column, Column, Column, Column]:
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    w = trailing(n, *keys)
    mean = lambda c: full(F.avg(c), c, w, n)
    return mean(a), mean(b), mean(a * b), mean(a * a)


def rolling_beta(df: DataFrame, n: int = 60, y: str = "ret", x: str = "f", key: str = "ticker") -> DataFrame:
    """df with beta and alpha of y on x over n rows in which both are present; null for a constant x."""
    mx, my, mxy, mxx = _means(n, x, y, key)
    var = mxx - mx * mx
    df = df.withColumn("beta", F.when(var > 1e-18, (mxy - mx * my) / var))
    return df.withColumn("alpha", my - F.col("beta") * mx)


def residual(df: DataFrame, n: int = 60, y: str = "ret", x: str = "f", key: str = "ticker") -> DataFrame:
    """resid: y less yesterday's alpha and beta times x (signal space); hedged: y less yesterday's beta times x (P&L space)."""
    df = rolling_beta(df, n, y, x, key)
    a, b = F.lag("alpha").over(by(key)), F.lag("beta").over(by(key))
    return df.withColumn("resid", F.col(y) - a - b * F.col(x)).withColumn("hedged", F.col(y) - b * F.col(x))


def full_sample_residual(df: DataFrame, y: str = "ret", x: str = "f", key: str = "ticker") -> DataFrame:
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(ok, F.col(x)), F.when(ok, F.col(y))
    fit = df.groupBy(key).agg(F.avg(a).alias("_mx"), F.avg(b).alias("_my"), F.avg(a * b).alias("_mxy"), F.avg(a * a).alias("_mxx"))
    fit = fit.withColumn("_b", ratio(F.col("_mxy") - F.col("_mx") * F.col("_my"), F.col("_mxx") - F.col("_mx") * F.col("_mx")))
    return df.join(fit, key).withColumn("resid", F.col(y) - F.col("_my") - F.col("_b") * (F.col(x) - F.col("_mx"))).drop("_mx", "_my", "_mxy", "_mxx", "_b")


def s_score(df: DataFrame, n: int = 60, resid: str = "resid", key: str = "ticker") -> DataFrame:
    """level: running sum of residuals (null rows stay null); s: its distance from the rolling mean in rolling deviations."""
    df = df.withColumn("level", F.when(F.col(resid).isNotNull(), F.sum(resid).over(by(key).rowsBetween(*ALL))))
    return df.withColumn("s", ratio(F.col("level") - rolling_mean("level", n, key), rolling_std("level", n, key)))


def drift_s_score(df: DataFrame, n: int = 60, key: str = "ticker") -> DataFrame:
    """s less the drift over the speed of reversion, where the level's first-order slope b lies in (0, 1)."""
    df = df.withColumn("_prev", F.lag("level").over(by(key)))
    mx, my, mxy, mxx = _means(n, "_prev", "level", key)
    df = df.withColumn("b", ratio(mxy - mx * my, mxx - mx * mx))
    kappa = F.when((F.col("b") > 0) & (F.col("b") < 1), -F.ln(F.when(F.col("b") > 0, F.col("b"))))
    drift = rolling_mean("resid", n, key)
    return df.withColumn("s_drift", F.col("s") - ratio(drift, kappa * rolling_std("level", n, key))).drop("_prev")


def realized_vol(df: DataFrame, n: int, per_year: int = 252, ret: str = "ret", key: str = "ticker") -> DataFrame:
    return df.withColumn("vol", rolling_std(ret, n, key) * F.sqrt(F.lit(float(per_year))))


def ewma_vol(df: DataFrame, com: float, ret: str = "ret", key: str = "ticker") -> DataFrame:
    """Exponentially weighted deviation (adjusted, bias-corrected) over the key's rows with a return, as a fold over the ordered rows."""
    keep = com / (1 + com)
    rows = df.where(F.col(ret).isNotNull()).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("date", F.col(ret).alias("r")))).alias("h"))
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("w", "w2", "sx", "sxx")], F.array().cast("array<struct<date:date,ewma_vol:double>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        w, w2 = acc["w"] * keep + 1, acc["w2"] * keep * keep + 1
        sx, sxx = acc["sx"] * keep + x["r"], acc["sxx"] * keep + x["r"] * x["r"]
        var = F.try_divide((sxx / w - (sx / w) * (sx / w)) * w * w, w * w - w2)
        return F.struct(w.alias("w"), w2.alias("w2"), sx.alias("sx"), sxx.alias("sxx"), F.concat(acc["out"], F.array(F.struct(x["date"].alias("date"), F.when(var.isNotNull(), F.sqrt(F.greatest(var, F.lit(0.0)))).alias("ewma_vol")))).alias("out"))

    return rows.select(key, F.inline(F.aggregate("h", zero, step, lambda a: a["out"])))


def momentum(df: DataFrame, long: int, skip: int, key: str = "ticker") -> DataFrame:
    return df.withColumn("mom", ratio(F.lag("close", skip).over(by(key)), F.lag("close", long).over(by(key))) - 1)


def sma_ratio(df: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    return df.withColumn("sma", rolling_mean("close", n, key)).withColumn("above", F.col("close") / F.col("sma") - 1)


def rolling_corr_beta(df: DataFrame, n: int, x: str = "ret", y: str = "m", key: str = "ticker") -> DataFrame:
    mx, my, mxy, mxx = _means(n, x, y, key)
    ok = F.col(x).isNotNull() & F.col(y).isNotNull()
    b = F.when(ok, F.col(y))
    myy = full(F.avg(b * b), b, trailing(n, key), n)
    cov, vx, vy = mxy - mx * my, mxx - mx * mx, myy - my * my
    good = (vx > 1e-18) & (vy > 1e-18)
    return df.withColumn("corr", F.when(good, cov / F.sqrt(F.when(good, vx * vy)))).withColumn("cov_beta", F.when(vy > 1e-18, cov / vy))


def drawdown(df: DataFrame, ret: str = "net", *keys: str) -> DataFrame:
    """nav, peak, dd (<= 0) and whether the series is under its peak."""
    w = by(*keys).rowsBetween(*ALL)
    df = df.withColumn("nav", F.exp(F.sum(F.log1p(F.coalesce(F.col(ret), F.lit(0.0)))).over(w)))
    df = df.withColumn("peak", F.greatest(F.lit(1.0), F.max("nav").over(w)))
    return df.withColumn("dd", F.col("nav") / F.col("peak") - 1).withColumn("under", F.col("nav") < F.col("peak"))


def rolling_year(df: DataFrame, n: int, step: int, ret: str = "net", *keys: str) -> DataFrame:
    """Compounded returns of n-row windows that begin every `step` rows; windows of mostly zero returns are left out."""
    w = trailing(n, *keys)
    df = df.withColumn("_n", F.row_number().over(by(*keys))).withColumn("year", F.exp(F.sum(F.log1p(F.col(ret))).over(w)) - 1).withColumn("_zero", F.sum((F.col(ret) == 0).cast("int")).over(w))
    return df.where((F.col("_n") >= n) & ((F.col("_n") - n) % step == 0) & (F.col("_zero") <= n / 2)).drop("_n", "_zero")


def runs(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """Runs of an unchanged value in date order: start, end, n. Null is a value."""
    w = by(*keys)
    new = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)), F.lit(True)) | (F.row_number().over(w) == 1)
    df = df.withColumn("_new", new.cast("int")).withColumn("_run", F.sum("_new").over(w))
    return df.groupBy(*keys, "_run").agg(F.first(value).alias(value), F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n")).drop("_run")


def forward_return(df: DataFrame, h: int, key: str = "ticker") -> DataFrame:
    return df.withColumn("fwd", F.lead("close", h).over(by(key)) / F.col("close") - 1)


def spread_z(df: DataFrame, n: int) -> DataFrame:
    """(a, b, date, spread) with the spread's z over n rows."""
    return df.withColumn("z", ratio(F.col("spread") - rolling_mean("spread", n, "a", "b"), rolling_std("spread", n, "a", "b")))


def pair_z_oos(df: DataFrame, cut: str) -> DataFrame:
    """z after the cut with mean and deviation of the formation window up to it."""
    on = F.col("date") <= F.lit(cut).cast("date")
    fit = df.where(on).groupBy("a", "b").agg(F.avg("spread").alias("mu"), F.stddev_samp("spread").alias("sd"))
    return df.where(~on).join(fit, ["a", "b"]).select("a", "b", "date", ratio(F.col("spread") - F.col("mu"), F.col("sd")).alias("z"))


def signals(df: DataFrame, month: int = 4, year: int = 52, quarter: int = 13) -> DataFrame:
    """Ten fit-free signals of a (date, ticker, sector, open, close, volume, ret, f) panel, one column each."""
    w, day = by("ticker"), Window.partitionBy("date", "sector")
    back = lambda n: F.lag("close", n).over(w)
    df = df.withColumn("_mom", ratio(back(month), back(year)) - 1).withColumn("_resid", F.col("ret") - F.col("f")).withColumn("_on", F.ln(F.col("open") / back(1))).withColumn("_id", F.ln(F.col("close") / F.col("open")))
    df = df.withColumn("_rs", rolling_sum("_resid", year - month, "ticker")).withColumn("_sd", rolling_std("ret", quarter, "ticker")).withColumn("_max", full(F.max("close"), F.col("close"), trailing(year, "ticker"), year))
    df = df.withColumn("_disp", rolling_std("_resid", quarter, "ticker")).withColumn("_gap", F.when(F.col("_on").isNotNull(), ((F.abs(F.col("_on")) > 2 * F.col("_sd")) & (F.signum("_on") == F.signum("_id"))).cast("int")))
    return df.select(
        "date", "ticker",
        (-(ratio(F.col("close"), back(month)) - 1)).alias("reversal"), (F.col("_mom") - F.avg("_mom").over(day)).alias("sector_rel_mom"), F.lag("_rs", month).over(w).alias("residual_mom"), (-F.col("_disp")).alias("ivol_low"),
        (F.col("_disp") - F.percentile("_disp", F.lit(0.5)).over(day)).alias("dispersion"), ratio(rolling_mean("volume", month, "ticker"), rolling_mean("volume", year, "ticker")).alias("volume_shock"),
        (rolling_sum("_on", quarter, "ticker") - rolling_sum("_id", quarter, "ticker")).alias("overnight_share"), F.sum("_gap").over(trailing(quarter, "ticker")).cast("long").alias("gap_persistence"), (-F.col("_sd")).alias("low_vol"), ratio(F.col("close"), F.col("_max")).alias("high_52w"),
    )
