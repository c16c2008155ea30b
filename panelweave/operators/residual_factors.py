"""Factors in what known factors leave of returns: betas before an analysis window, residuals within it, the residuals' components and their vetting.

Windows don't overlap and step back from the last date. Everything over names is sums per window, or per window and date; what is solved is as small as
the number of known factors and sectors, or (vetting) as the dates of a window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import f_p, ratio
from panelweave.operators import spectrum as S


def analysis_windows(returns: DataFrame, factors: DataFrame, names: list[str], n_beta: int, n_an: int, zeros: float = 0.2) -> DataFrame:
    """(win, analysis, date, ticker, ret, names): n_an dates to analyse and the n_beta before them; win is the first date analysed.

    A name takes part if it has a return on every date of both stretches, varies in both, and has no more than the given share of zero returns in either.
    """
    known = factors.select("date", *names).dropna()
    days = returns.select("date").distinct().join(known, "date")
    days = days.withColumn("_back", F.row_number().over(Window.orderBy(F.desc("date"))) - 1).withColumn("_all", F.count("*").over(Window.partitionBy(F.lit(1))))  # one row per date
    last = F.floor((F.col("_all") - n_an - n_beta) / n_an)
    own = F.floor(F.col("_back") / n_an)
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_back") + 1 - n_an - n_beta) / n_an))
    days = days.withColumn("_w", F.explode(F.when(first <= F.least(own, last), F.sequence(first, F.least(own, last)))))
    days = days.withColumn("analysis", F.col("_w") == own)
    starts = days.where("analysis").groupBy("_w").agg(F.min("date").alias("win"))
    rows = days.join(starts, "_w").select("win", "analysis", "date", *names).join(returns.where("ret is not null").select("date", "ticker", "ret"), "date")
    good = rows.groupBy("win", "ticker", "analysis").agg(F.count("*").alias("n"), F.stddev_samp("ret").alias("sd"), F.avg((F.col("ret") == 0).cast("double")).alias("z"))
    good = good.where((F.col("n") == F.when(F.col("analysis"), n_an).otherwise(n_beta)) & (F.col("sd") > 1e-15) & (F.col("z") <= zeros)).groupBy("win", "ticker").agg(F.count("*").alias("n")).where("n = 2")
    return rows.join(good.select("win", "ticker"), ["win", "ticker"]).select("win", "analysis", "date", "ticker", "ret", *names)


def _batched(pdf: pd.DataFrame, a: str, b: str) -> np.ndarray:
    """Solutions of least norm, one for each row of sums a (k x k) and b (k)."""
    rhs = np.stack(pdf[b].to_numpy()).astype(float)
    k = rhs.shape[1]
    return np.einsum("nij,nj->ni", np.linalg.pinv(np.stack(pdf[a].to_numpy()).astype(float).reshape(-1, k, k), rcond=1e-12, hermitian=True), rhs)


def betas(rows: DataFrame, names: list[str]) -> DataFrame:
    """(win, ticker, vol, beta): the deviation before the analysis, and the OLS slopes (with a constant) of returns in units of it."""
    x = [F.lit(1.0), *[F.col(c) for c in names]]
    before = rows.where(~F.col("analysis"))
    sums = before.groupBy("win", "ticker").agg(F.stddev_samp("ret").alias("vol"), F.array(*[F.sum(a * b) for a in x for b in x]).alias("a"), F.array(*[F.sum(a * F.col("ret")) for a in x]).alias("b"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pdf[["win", "ticker", "vol"]].assign(beta=list(_batched(pdf, "a", "b")[:, 1:] / pdf["vol"].to_numpy()[:, None]))

    return sums.mapInPandas(solve, "win date, ticker string, vol double, beta array<double>")


def residuals(rows: DataFrame, beta: DataFrame, k: int, sectors: DataFrame | None = None, values: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(win, date, ticker, ret) of the analysis dates, in units of the deviation before, less each date's cross-sectional fit on the k betas (and one
    column for each listed sector), and (win, date, implied), the fit's coefficients."""
    design = F.col("beta")
    x = rows.where("analysis").join(beta, ["win", "ticker"])
    if sectors is not None:
        x = x.join(sectors.select("ticker", "sector"), "ticker")
        design = F.concat("beta", F.array(*[(F.col("sector") == v).cast("double") for v in values]))
        k += len(values)
    x = x.select("win", "date", "ticker", (F.col("ret") / F.col("vol")).alias("y"), design.alias("d"))
    at = lambda i: F.get("d", F.lit(i))
    sums = x.groupBy("win", "date").agg(F.array(*[F.sum(at(i) * at(j)) for i in range(k) for j in range(k)]).alias("a"), F.array(*[F.sum(at(i) * F.col("y")) for i in range(k)]).alias("b"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            if len(pdf):
                yield pdf[["win", "date"]].assign(implied=list(_batched(pdf, "a", "b")))

    implied = sums.mapInPandas(solve, "win date, date date, implied array<double>")
    fit = F.aggregate(F.zip_with("d", "implied", lambda d, f: d * f), F.lit(0.0), lambda s, v: s + v)
    return x.join(implied, ["win", "date"]).select("win", "date", "ticker", (F.col("y") - fit).alias("ret")), implied


def angles(vectors: DataFrame, k: int, column: str = "beta") -> DataFrame:
    """(win, shared, angles, median): principal angles in degrees, rising, between the spaces that the k columns span in a window and in the one before, over the names that both have.

    The spaces are compared by sums of products of k columns; a window without a full-rank neighbour has no row.
    """
    order = vectors.select("win").distinct().withColumn("_next", F.lead("win").over(Window.orderBy("win")))  # one row per window
    before = vectors.join(order, "win").select(F.col("_next").alias("win"), "ticker", F.col(column).alias("_b"))
    x = vectors.join(before, ["win", "ticker"]).withColumnRenamed(column, "_a")
    at = lambda c, i: F.get(c, F.lit(i))
    gram = lambda c, d: F.array(*[F.sum(at(c, i) * at(d, j)) for i in range(k) for j in range(k)])
    sums = x.groupBy("win").agg(F.count("*").alias("shared"), gram("_a", "_a").alias("aa"), gram("_b", "_b").alias("bb"), gram("_b", "_a").alias("ba"))

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for win, shared, aa, bb, ba in pdf.itertuples(index=False):
                aa, bb, ba = (np.asarray(m, dtype=float).reshape(k, k) for m in (aa, bb, ba))
                if shared < k or min(np.linalg.eigvalsh(m)[0] / max(np.trace(m), 1e-300) for m in (aa, bb)) < 1e-12:
                    continue
                left, right = (np.linalg.inv(np.linalg.cholesky(m)) for m in (bb, aa))
                found = np.sort(np.degrees(np.arccos(np.clip(np.linalg.svd(left @ ba @ right.T, compute_uv=False), -1, 1))))
                out.append((win, shared, found, float(np.median(found))))
            yield pd.DataFrame(out, columns=["win", "shared", "angles", "median"])

    return sums.mapInPandas(solve, "win date, shared long, angles array<double>, median double")


def r2_and_null(scores: DataFrame, factors: DataFrame, names: list[str], high: float = 0.99, low: float = 0.75) -> DataFrame:
    """(win, factor, dates, r2, local, null_high, null_low): a component's R2 on the known factors (with a constant), its largest date's share of its squares, and the window's quantiles of the
    R2 that circular shifts of its components reach. A window's group is its dates."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot(index="date", columns="factor", values="score").sort_index()
        f = pdf.drop_duplicates("date").set_index("date").loc[wide.index, names].to_numpy(dtype=float)
        q, _ = np.linalg.qr(f - f.mean(axis=0))
        x = wide.to_numpy(dtype=float)
        n, k = x.shape
        x0 = x - x.mean(axis=0)
        size = np.maximum((x0**2).sum(axis=0), 1e-300)
        share = lambda y: ((q.T @ y) ** 2).sum(axis=0) / size
        null = np.concatenate([share(np.roll(x0, s, axis=0)) for s in range(1, n)])
        hi, lo = np.quantile(null, [high, low])
        local = (x**2).max(axis=0) / np.maximum((x**2).sum(axis=0), 1e-300)
        return pd.DataFrame({"win": pdf["win"].iloc[0], "factor": wide.columns, "dates": n, "r2": share(x0), "local": local, "null_high": hi, "null_low": lo})

    both = scores.join(factors.select("date", *names), "date")
    return both.groupBy("win").applyInPandas(solve, "win date, factor int, dates int, r2 double, local double, null_high double, null_low double")


def chained_signs(load: DataFrame, k: int, least: int = 10) -> DataFrame:
    """(win, factor, sign): the product, over the windows so far, of the signs of a component's correlation with itself a window before, over shared names; fewer than `least` turn nothing."""
    order = load.select("win").distinct().withColumn("_next", F.lead("win").over(Window.orderBy("win")))  # one row per window
    long = load.select("win", "ticker", F.posexplode("s").alias("_f", "_v")).where(F.col("_f") < k)
    before = long.join(order, "win").select(F.col("_next").alias("win"), "ticker", "_f", F.col("_v").alias("_b"))
    turn = long.join(before, ["win", "ticker", "_f"]).groupBy("win", "_f").agg(F.when((F.count("*") >= least) & (F.corr("_v", "_b") < 0), -1).otherwise(1).alias("_turn"))
    every = order.select("win", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_f")).join(turn, ["win", "_f"], "left")
    w = Window.partitionBy("_f").orderBy("win").rowsBetween(Window.unboundedPreceding, 0)
    turns = F.count_if(F.coalesce("_turn", F.lit(1)) < 0).over(w)
    return every.select("win", (F.col("_f") + 1).alias("factor"), F.when(turns % 2 == 0, 1).otherwise(-1).alias("sign"))


def vetted(noise: DataFrame, tested: DataFrame, known: int, most_local: float = 0.3) -> DataFrame:
    """(win, factor, snr, trusted, floor, r2, p, local, bucket, reason): which components may serve as residual factors.

    The first is never one. Others go for strength under the edge, a floor outside [0, 1], leaking known factors (R2 at the null's high quantile and an F test under 1 %) or sitting on one date. reason
    is empty for those that stay.
    """
    x = noise.join(tested, ["win", "factor"])
    below = F.col("dates") - 1 - known
    f = ratio(F.col("r2") / known, (1 - F.col("r2")) / below)
    x = x.withColumn("p", f_p(f, F.lit(known), below))
    at_high = F.col("r2") >= F.col("null_high")
    bucket = F.when(~F.col("trusted"), "noise-like").when(at_high, "likely-leaked").when(F.col("r2") < F.col("null_low"), "candidate").otherwise("mixed")
    why = F.when(F.col("factor") == 1, "first").otherwise(
        F.concat_ws(
            ";", F.when(~F.col("trusted"), "weak"), F.when(~F.col("floor").between(0, 1), "floor"), F.when(at_high & (F.col("p") < 0.01), "leaks"), F.when(F.col("local") > most_local, "local")
        )
    )
    return x.select("win", "factor", "snr", "trusted", "floor", "r2", "p", "local", bucket.alias("bucket"), why.alias("reason"))


def residual_factors(residual: DataFrame, factors: DataFrame, names: list[str], k: int = 5, most_local: float = 0.3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """The vetted components of residual returns (win, factor, ...), and the series (win, date, factor, x) of those that stay, signs chained over windows."""
    keys = ["win"]
    x = S.vectors(residual, keys, centred=False)
    spec = S.spectrum(x, keys, k)
    series = S.scores(spec, residual.select("win", "date").distinct(), keys)
    table = vetted(S.noise(spec, keys, k), r2_and_null(series, factors, names), len(names), most_local)
    load = S.loadings(x, spec, keys, k)
    # the series follow the spectrum's own signs, the loadings those of their sums
    dots = x.join(spec.select("win", "u"), "win").select("win", F.posexplode("u").alias("_f", "_u"), "x")
    dot = F.aggregate(F.zip_with("_u", "x", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    first = dots.withColumn("_d", dot).groupBy("win", (F.col("_f") + 1).alias("factor")).agg(F.when(F.sum("_d") < 0, -1).otherwise(1).alias("_own"))
    signs = chained_signs(load, k, least).join(first, ["win", "factor"])
    kept = series.join(table.where("reason = ''").select("win", "factor"), ["win", "factor"]).join(signs, ["win", "factor"])
    return table, kept.select("win", "date", "factor", (F.col("score") * F.col("sign") * F.col("_own")).alias("x"))
