"""Alphas after more and more known factors, what is left of a series after a projection, and what a fitted menu of factors earns."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, corr_from_sums, ratio
from panelweave.operators import metrics as M
from panelweave.operators.inference import EXACT, nw_ols, sign_flip, windows


def least_squares(rows: DataFrame, keys: list[str], y: str, xs: list[str]) -> DataFrame:
    """(keys, _b): coefficients of y on a constant and xs per group, from one row of sums; of least norm where they are collinear. Rows with a null don't count."""
    return layered_least_squares(rows, keys, y, [xs]).withColumn("_b", F.get("_b", F.lit(0)))


def layered_least_squares(rows: DataFrame, keys: list[str], y: str, layers: list[list[str]]) -> DataFrame:
    """(keys, _b): per group the coefficients of y on a constant and each layer's xs, all from one row of the last layer's sums; every layer begins the next."""
    xs = layers[-1]
    if any(xs[: len(layer)] != layer for layer in layers):
        raise ValueError("a layer doesn't begin the last one")
    rows = rows.dropna(subset=[y, *xs])
    x = [F.lit(1.0), *[F.col(c) for c in xs]]
    k = len(x)
    sums = rows.groupBy(*keys).agg(F.array(*[F.sum(a * b) for a in x for b in x]).alias("a"), F.array(*[F.sum(a * F.col(y)) for a in x]).alias("v"))
    kinds = dict(rows.dtypes)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            b = []
            for a, v in zip(pdf["a"], pdf["v"], strict=True):
                m, v = np.asarray(a, dtype=float).reshape(k, k), np.asarray(v, dtype=float)
                scale = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
                m = m / np.outer(scale, scale)
                b.append([np.linalg.pinv(m[:j, :j], rcond=1e-12, hermitian=True) @ (v / scale)[:j] / scale[:j] for j in (len(layer) + 1 for layer in layers)])
            yield pdf[keys].assign(_b=b)

    return sums.mapInPandas(solve, ", ".join([*[f"{c} {kinds[c]}" for c in keys], "_b array<array<double>>"]))


def _fitted(b: str, xs: list[str]) -> Column:
    return sum((F.get(b, F.lit(i + 1)) * F.col(x) for i, x in enumerate(xs)), F.get(b, F.lit(0)))


def projection_residual(rows: DataFrame, y: str, xs: list[str], until: Column | None = None) -> DataFrame:
    """(date, residual): y less its projection on a constant and xs over the whole sample, or over the dates up to `until`, so that later residuals know nothing of their own dates."""
    one = rows.dropna(subset=[y, *xs]).withColumn("_k", F.lit(1))
    b = least_squares(one.where(F.col("date") <= until) if until is not None else one, ["_k"], y, xs)
    return one.join(F.broadcast(b), "_k").select("date", (F.col(y) - _fitted("_b", xs)).alias("residual"))  # one row of coefficients


def fitted_menu(rows: DataFrame, xs: list[str], lags: int, per_year: int, trials: int) -> DataFrame:
    """(book, n, r2, alpha, t, explained, sharpe_p, trials_p): yearly alpha of net against a fitted mix of xs with its Newey-West t, what the mix earned a year, and the probability that the book's sharpe beats the luck of `trials`
    tries, and of as many as there are books with their own dispersion."""
    fit = nw_ols(rows, ["book"], "net", xs, lags)
    means = rows.dropna(subset=["net", *xs]).groupBy("book").agg(*[F.avg(x).alias(x) for x in xs])
    part = fit.join(means, "book").withColumn("_e", F.coalesce(*[F.when(F.col("term") == x, F.col("coef") * F.col(x)) for x in xs], F.lit(0.0)))
    const = lambda c: F.max(F.when(F.col("term") == "const", F.col(c)))
    out = part.groupBy("book").agg(F.first("n").alias("n"), F.first("r2").alias("r2"), (const("coef") * per_year).alias("alpha"), const("t").alias("t"), (F.sum("_e") * per_year).alias("explained"))
    luck = M.deflated_sharpe(rows.select("book", "date", "net"), trials).select("book", F.col("p").alias("sharpe_p"), F.col("p_trials").alias("trials_p"))
    return out.join(luck, "book")


def alpha_ladder(rows: DataFrame, layers: list[list[str]], premium: str, size: int, sims: int, level: float = 0.05, share: float = 0.6, like: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(book, layer, windows, mean, t, share, p): each layer's alphas over stretches of `size` rows, the larger share of them on one side, and a sign-flip test whose patterns all layers share;
    and (book, rho, halves, label).

    layers: the regressors of each, the first none. label: `little` where the plain mean's t is under one; `premium` where what the last layer but one leaves goes with the premium series; else the first layer that takes a sure
    alpha away, `layer 2` and on; `alpha` if the last layer's is sure and has one sign in both halves; otherwise `mixed`. A stretch with too few rows isn't used. Alphas that are rounding have no t, no side and the sign zero.
    """
    need = sorted({x for xs in layers for x in xs} | {premium})
    w = windows(rows.dropna(subset=["net", *need]), ["book"], size, size)
    fits = [least_squares(w, ["book", "start"], "net", xs).select("book", "start", F.lit(i + 1).alias("layer"), F.get("_b", F.lit(0)).alias("alpha")) for i, xs in enumerate(layers)]
    a = reduce(DataFrame.unionByName, fits).withColumn("_pos", (F.col("start") / size).cast("long"))
    table = sign_flip(a.withColumnRenamed("_pos", "pos"), ["book", "layer"], sims).select("book", "layer", "windows", "mean", "t", "share", "p")

    inner = layers[-2]
    left = w.join(least_squares(w, ["book", "start"], "net", inner), ["book", "start"]).withColumn("_u", F.col("net") - _fitted("_b", inner))
    rho = left.groupBy("book").agg(corr_from_sums(F.col("_u"), F.col(premium)).alias("rho"))
    half = F.col("_pos") < F.floor(F.col("_n") / 2)
    last = a.where(F.col("layer") == len(layers)).withColumn("_n", F.count("*").over(Window.partitionBy("book")))
    side = lambda x: F.when(F.abs(x) <= EXACT, 0.0).otherwise(F.signum(x))
    halves = last.groupBy("book").agg((side(F.avg(F.when(half, F.col("alpha")))) == side(F.avg(F.when(~half, F.col("alpha"))))).alias("halves"))
    sure = (F.col("p") <= level) & (F.col("share") >= share)
    wide = table.groupBy("book").agg(F.max(F.when(F.col("layer") == 1, F.abs("t"))).alias("_t1"), *[F.max(F.when(F.col("layer") == i + 1, sure)).alias(f"_s{i}") for i in range(len(layers))])
    label = F.when(F.coalesce(F.col("_t1") < 1, F.lit(True)), "little").when(F.abs("rho") >= like, "premium")
    for i in range(1, len(layers)):
        label = label.when(F.col(f"_s{i - 1}") & ~F.col(f"_s{i}"), f"layer {i + 1}")
    label = label.when(F.col(f"_s{len(layers) - 1}") & F.col("halves"), "alpha").otherwise("mixed")
    return table, wide.join(rho, "book").join(halves, "book").select("book", "rho", "halves", label.alias("label"))


def layered_alpha(rows: DataFrame, layers: list[list[str]], premium: str, cash: str, gross: DataFrame, luck: DataFrame, size: int, sims: int, per_year: int, level: float = 0.05, share: float = 0.6, like: float = 0.5, spread: float = 0.005) -> DataFrame:
    """(book, layer, windows, mean, share_up, share, p, half1, half2, rho, stressed, sharpe_p, trials_p, label): each layer's alphas over stretches of `size` rows under one set of sign patterns, and the book's label.

    rows: (book, date, net over cash, factors, premium, cash); layers: the regressors of each, the first none; gross: (book, gross); luck: (book, sharpe_p, trials_p), the probabilities that the sharpe is no luck. half1, half2: the last layer's
    mean in either half of the stretches; rho: of what the last layer but one leaves with the premium; stressed: the last layer's yearly alpha if what is held above one is borrowed at cash and a spread.
    label: `little` where the plain mean's t is under one; `premium` where rho is large; else the first layer that takes a sure alpha away, `layer 2` and on; `alpha` if the last layer's is sure, has one sign in both halves,
    survives the financing, and neither probability is under one half; otherwise `mixed`.
    """
    need = sorted({x for xs in layers for x in xs} | {premium, cash})
    w = windows(rows.dropna(subset=["net", *need]), ["book"], size, size)
    fit = layered_least_squares(w, ["book", "start"], "net", layers).withColumn("pos", (F.col("start") / size).cast("long"))
    half = F.when(F.col("pos") < F.floor(F.count("*").over(Window.partitionBy("book")) / 2), 0).otherwise(1)
    a = fit.withColumn("_half", half).select("book", "pos", "_half", F.posexplode("_b").alias("_i", "_c")).select("book", (F.col("_i") + 1).alias("layer"), "pos", "_half", F.get("_c", F.lit(0)).alias("alpha"))

    inner, last = layers[-2], len(layers)
    left = w.join(fit.select("book", "start", F.get("_b", F.lit(last - 2)).alias("_b")), ["book", "start"]).withColumn("_u", F.col("net") - _fitted("_b", inner))
    of = left.groupBy("book").agg(corr_from_sums(F.col("_u"), F.col(premium)).alias("rho"), (F.avg(cash) * per_year + spread).alias("_cost"))
    halves = a.where(F.col("layer") == last).groupBy("book").agg(*[F.avg(F.when(F.col("_half") == i, F.col("alpha"))).alias(f"half{i + 1}") for i in (0, 1)])
    of = of.join(halves, "book").join(gross, "book").join(luck, "book")

    t = sign_flip(a, ["book", "layer"], sims).join(of, "book")
    in_book = Window.partitionBy("book")
    at = lambda i, c: F.max(F.when(F.col("layer") == i, c)).over(in_book)
    sure = (F.col("p") <= level) & (F.col("share") >= share)
    t = t.withColumn("stressed", at(last, F.col("mean")) * per_year - F.greatest(F.col("gross") - 1, F.lit(0.0)) * F.col("_cost"))
    label = F.when(F.coalesce(at(1, F.abs("t")) < 1, F.lit(True)), "little").when(F.abs("rho") >= like, "premium")
    for i in range(1, last):
        label = label.when(at(i, sure) & ~at(i + 1, sure), f"layer {i + 1}")
    proven = at(last, sure) & (F.signum("half1") == F.signum("half2")) & (F.col("sharpe_p") >= 0.5) & (F.col("trials_p") >= 0.5) & (F.col("stressed") > 0)
    return t.select("book", "layer", "windows", "mean", "share_up", "share", "p", "half1", "half2", "rho", "stressed", "sharpe_p", "trials_p", label.when(proven, "alpha").otherwise("mixed").alias("label"))


def centred_mean(panel: DataFrame, n: int, value: str = "close") -> DataFrame:
    """(date, ticker, mid): the mean of n rows on either side, which knows the future; an input that an audit must block."""
    w = by("ticker").rowsBetween(-n, n)
    return panel.select("date", "ticker", F.avg(value).over(w).alias("mid"))
