"""Covariance windows and learning jobs: Spark does eligibility, windows, joins and scores; only the dense solve runs inside a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, ratio


def window_rows(returns: DataFrame, n: int) -> DataFrame:
    """(month, date, ticker, ret): for each month the n dates before it, of tickers with all n returns."""
    days = returns.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))
    first = days.groupBy(F.to_date(F.date_trunc("month", "date")).alias("month")).agg(F.min("pos").alias("at")).where(F.col("at") > n)
    each = first.select("month", F.explode(F.sequence(F.col("at") - n, F.col("at") - 1)).alias("pos")).join(days, "pos")
    rows = each.join(returns.where("ret is not null").select("date", "ticker", "ret"), "date")
    return rows.withColumn("_n", F.count("*").over(Window.partitionBy("month", "ticker"))).where(F.col("_n") == n).select("month", "date", "ticker", "ret")


def cov_pairs(rows: DataFrame) -> DataFrame:
    """Sample covariance in long form, a <= b, per month."""
    a = rows.select("month", "date", F.col("ticker").alias("a"), F.col("ret").alias("x"))
    b = rows.select("month", "date", F.col("ticker").alias("b"), F.col("ret").alias("y"))
    return a.join(b, ["month", "date"]).where("a <= b").groupBy("month", "a", "b").agg(F.covar_samp("x", "y").alias("cov"))


def shrunk(r: np.ndarray, how: str) -> np.ndarray:
    """sample; identity: linear shrinkage to a scaled identity with the estimated best intensity; factor: first component plus diagonal;
    constant_correlation: toward equal correlations with the estimated best intensity; clip: correlation eigenvalues under the noise edge replaced by their mean."""
    x = r - r.mean(axis=0)
    t, p = x.shape
    s = x.T @ x / t
    if how == "identity":
        m = np.trace(s) / p
        gap = ((s - m * np.eye(p)) ** 2).sum() / p
        noise = sum(((np.outer(row, row) - s) ** 2).sum() for row in x) / (t * t * p)
        a = min(1.0, noise / gap) if gap > 0 else 1.0
        return a * m * np.eye(p) + (1 - a) * s
    if how == "factor":
        value, vector = np.linalg.eigh(s)
        common = value[-1] * np.outer(vector[:, -1], vector[:, -1])
        return common + np.diag(np.maximum(np.diag(s - common), 1e-12))
    if how in ("constant_correlation", "clip"):
        sd = np.sqrt(np.maximum(np.diag(s), 1e-18))
        c = s / np.outer(sd, sd)
        if how == "constant_correlation":
            mean = (c.sum() - p) / max(p * (p - 1), 1)
            a = equal_correlation_intensity(x, s, sd, mean)
            c = (1 - a) * c + a * (mean + (1 - mean) * np.eye(p))
        else:
            value, vector = np.linalg.eigh(c)
            noise = value < (1 + np.sqrt(p / t)) ** 2
            value = np.where(noise, value[noise].mean() if noise.any() else 0.0, value)
            c = vector @ np.diag(value) @ vector.T
            c = c / np.sqrt(np.outer(np.diag(c), np.diag(c)))
        return c * np.outer(sd, sd) * t / (t - 1)
    return s * t / (t - 1)


def equal_correlation_intensity(x: np.ndarray, s: np.ndarray, sd: np.ndarray, mean: float) -> float:
    """The share of the equal-correlation target, within [0, 1], that makes the expected squared error least: what the sample's entries vary, less what they vary together with the target's, over how far the two lie apart and the
    number of dates. x: centred returns, s: their covariance, mean: the mean correlation."""
    t, p = x.shape
    target = mean * np.outer(sd, sd)
    np.fill_diagonal(target, np.diag(s))
    apart = ((s - target) ** 2).sum()
    if apart <= 0:
        return 1.0
    vary = (x**2).T @ (x**2) / t - s**2
    with_own = (x**3).T @ x / t - np.diag(s)[:, None] * s  # of an entry with its row's variance
    together = np.trace(vary) + mean * ((with_own * np.outer(1 / sd, sd)).sum() - np.trace(with_own))
    return float(np.clip((vary.sum() - together) / apart / t, 0.0, 1.0))


def min_variance(rows: DataFrame, how: str, cap: float = 0.2) -> DataFrame:
    """(month, ticker, w): minimum-variance weights, negative ones cut, capped, brought to one. One window is one group."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="ticker", values="ret").sort_index()
        c = shrunk(wide.to_numpy(), how)
        w = np.linalg.lstsq(c + 1e-12 * np.eye(len(c)), np.ones(len(c)), rcond=None)[0]
        w = np.minimum(np.maximum(w / w.sum(), 0), cap)
        return pd.DataFrame({"month": pdf["month"].iloc[0], "ticker": wide.columns, "w": w / w.sum()})

    return rows.groupBy("month").applyInPandas(solve, "month date, ticker string, w double")


def scoreboard(weights: DataFrame, returns: DataFrame, per_year: int) -> DataFrame:
    """Realised volatility of monthly weights held through their month, and mean turnover against the month before."""
    r = returns.where("ret is not null").withColumn("month", F.to_date(F.date_trunc("month", "date")))
    net = weights.join(r, ["month", "ticker"]).groupBy("date").agg(F.sum(F.col("w") * F.col("ret")).alias("net"))
    months = weights.select("month").distinct().withColumn("next", F.lead("month").over(Window.orderBy("month")))
    before = weights.join(months, "month").select(F.col("next").alias("month"), "ticker", F.col("w").alias("b")).where("month is not null")
    moved = weights.join(before, ["month", "ticker"], "full").groupBy("month").agg(F.sum(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("b", F.lit(0.0)))).alias("t"))
    vol = net.agg(F.count("*").alias("n"), (F.stddev_samp("net") * F.sqrt(F.lit(float(per_year)))).alias("vol"))
    return vol.crossJoin(F.broadcast(moved.agg(F.avg("t").alias("turnover"))))  # one row each


def window_pca(rows: DataFrame, k: int) -> DataFrame:
    """(month, factor, strength, share): the k strongest components of each window, from its Gram matrix over dates."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.pivot(index="date", columns="ticker", values="ret").sort_index().to_numpy()
        x = x - x.mean(axis=0)
        value = np.linalg.eigvalsh(x @ x.T)[::-1]
        return pd.DataFrame({"month": pdf["month"].iloc[0], "factor": np.arange(1, k + 1), "strength": value[:k] / x.shape[1], "share": value[:k] / value.sum()})

    return rows.groupBy("month").applyInPandas(solve, "month date, factor int, strength double, share double")


def signal_features(signals: DataFrame, n: int = 12) -> DataFrame:
    """mom and vol over n months, and y, the next month's return."""
    w = by("signalname")
    full = F.count("ret").over(w.rowsBetween(-(n - 1), 0)) == n
    return signals.select("signalname", "date", F.when(full, F.sum("ret").over(w.rowsBetween(-(n - 1), 0))).alias("mom"), F.when(full, F.stddev_samp("ret").over(w.rowsBetween(-(n - 1), 0))).alias("vol"), F.lead("ret").over(w).alias("y"))


def expanding_ols(features: DataFrame, least: int, every: int, ridge: float = 0.0) -> DataFrame:
    """Prediction of y by mom, fitted on all earlier months by running sums; refitted every `every` months, none before `least` months.

    ridge: the penalty on the slope, in units of the centred sum of squares of mom."""
    ok = features.where("mom is not null and y is not null")
    m = ok.groupBy("date").agg(F.count("*").alias("n"), F.sum("mom").alias("x"), F.sum("y").alias("v"), F.sum(F.col("mom") * F.col("y")).alias("xv"), F.sum(F.col("mom") * F.col("mom")).alias("xx"))
    w = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    sums = m.select("date", (F.row_number().over(Window.orderBy("date")) - 1).alias("i"), *[F.sum(c).over(w).alias(c) for c in ("n", "x", "v", "xv", "xx")])
    slope = ratio(F.col("xv") * F.col("n") - F.col("x") * F.col("v"), (F.col("xx") * F.col("n") - F.col("x") * F.col("x")) * (1 + ridge))
    fit = sums.withColumn("b", slope).withColumn("a", (F.col("v") - F.col("b") * F.col("x")) / F.col("n"))
    refit = (F.col("i") >= least) & ((F.col("i") - least) % every == 0)
    keep = lambda c: F.last(F.when(refit, F.col(c)), ignorenulls=True).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    fit = fit.select("date", keep("a").alias("a"), keep("b").alias("b"))
    return features.where("mom is not null").join(fit, "date").select("signalname", "date", (F.col("a") + F.col("b") * F.col("mom")).alias("prediction"))

