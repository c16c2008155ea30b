"""Principal components of signal returns, refitted on an expanding history.

One matrix of sums over the signals, dates by dates, serves every refit: the first i dates' block, centred twice, is the Gram matrix of the first i dates'
centred returns, so a refit reads no return again. Loadings are sums over a signal's own history; later dates are projected on loadings fitted before them.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import ratio
from panelweave.operators import spectrum as S


def full_history(signals: DataFrame, name: str = "signalname") -> DataFrame:
    """(date, ticker, ret) of the signals that have a return on every date."""
    rows = signals.where("ret is not null").select("date", F.col(name).alias("ticker"), "ret")
    days = signals.where("ret is not null").agg(F.count_distinct("date").alias("_all"))
    whole = rows.groupBy("ticker").agg(F.count("*").alias("_n")).crossJoin(F.broadcast(days)).where("_n = _all")  # one row of days
    return rows.join(whole.select("ticker"), "ticker").select("date", "ticker", "ret")


def refits(x: DataFrame, k: int, least: int, every: int) -> DataFrame:
    """(start, stop, size2, u): for each refit the number of dates before it, the first date that it no longer serves, and the k strongest components over its dates.

    x: (ticker, x) of full histories. A refit's group is one matrix of dates by dates.
    """
    keyed = x.withColumn("_k", F.lit(1))
    sums = _sums(keyed)
    at = sums.select("g", F.explode(F.sequence(F.lit(least), F.sqrt(F.size("g").cast("double")).cast("int") - 1, F.lit(every))).alias("start")).where(F.size("g") > least * least)

    def solve(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            out = []
            for g, i in zip(pdf["g"], pdf["start"], strict=True):
                n = int(round(len(g) ** 0.5))
                own = np.asarray(g).reshape(n, n)[:i, :i]
                own = own - own.mean(axis=0) - own.mean(axis=1)[:, None] + own.mean()
                value, vector = np.linalg.eigh((own + own.T) / 2)
                value, vector = np.maximum(value[::-1][:k], 0.0), vector[:, ::-1][:, :k]
                use = value > max(value[0], 1e-300) * 1e-12
                out.append((i, min(i + every, n), value[use], vector[:, use].T.tolist()))
            yield pd.DataFrame(out, columns=["start", "stop", "size2", "u"])

    return at.mapInPandas(solve, "start int, stop int, size2 array<double>, u array<array<double>>")


def _sums(keyed: DataFrame) -> DataFrame:
    """(g): the sums over all signals of the products of two dates' returns."""
    buckets = max(1, -(-keyed.count() // S.BUCKET))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.stack(pdf["x"].to_numpy())
        return pd.DataFrame({"_k": [1], "g": [(m.T @ m).ravel()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [np.sum(np.stack(pdf["g"].to_numpy()), axis=0)]})

    bucket = F.pmod(F.xxhash64("ticker"), F.lit(buckets)).alias("_bucket")
    return keyed.select("_k", bucket, "x").groupBy("_k", "_bucket").applyInPandas(own, "_k int, g array<double>").groupBy("_k").applyInPandas(total, "g array<double>")


def component_returns(signals: DataFrame, k: int = 10, least: int = 60, every: int = 12, name: str = "signalname") -> tuple[DataFrame, DataFrame]:
    """(date, factor, ret) from the date with `least` dates before it on, and the loadings in use, (start, stop, factor, ticker, load, mean).

    A component's loadings have unit length and sum to no less than zero; a date's return is projected, less the means of the fit, on loadings from before it.
    """
    rows = full_history(signals, name)
    x = S.vectors(rows.withColumn("_k", F.lit(1)), ["_k"], centred=False).select("ticker", "x")
    made = refits(x, k, least, every)
    each = x.withColumn("_k", F.lit(1)).join(made.withColumn("_k", F.lit(1)), "_k").select("ticker", "x", "start", "stop", F.posexplode(F.arrays_zip("size2", "u")).alias("_f", "_c"))  # refits are as many as years
    dot = F.aggregate(F.zip_with(F.col("_c.u"), F.slice("x", 1, F.col("start")), lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    mean = F.aggregate(F.slice("x", 1, F.col("start")), F.lit(0.0), lambda s, v: s + v) / F.col("start")
    load = each.select("start", "stop", (F.col("_f") + 1).alias("factor"), "ticker", (dot / F.sqrt(F.col("_c.size2"))).alias("load"), mean.alias("mean"), "x")
    load = load.withColumn("load", F.when(F.sum("load").over(Window.partitionBy("start", "factor")) < 0, -F.col("load")).otherwise(F.col("load")))
    later = load.select("start", "factor", "load", "mean", F.posexplode(F.slice("x", F.col("start") + 1, F.col("stop") - F.col("start"))).alias("_j", "_v"))
    scores = later.groupBy((F.col("start") + F.col("_j") + 1).alias("pos"), "factor").agg(F.sum(F.col("load") * (F.col("_v") - F.col("mean"))).alias("ret"))
    days = rows.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))  # one row per date
    return scores.join(days, "pos").select("date", "factor", "ret"), load.drop("x")


def signal_weights(load: DataFrame, days: DataFrame, tilts: DataFrame | None = None) -> DataFrame:
    """(date, ticker, w): by the loadings in use at each date, gross one: of tilts (date, factor, tilt), demeaned over the components, or of all components alike.

    days: (date, pos from 1). A date whose tilts don't differ has no weights.
    """
    served = load.select("start", "stop").distinct().select("start", F.explode(F.sequence(F.col("start") + 1, F.col("stop"))).alias("pos")).join(days, "pos")
    use = load.join(served, "start")
    if tilts is None:
        use = use.withColumn("_t", F.lit(1.0))
    else:
        w = Window.partitionBy("date")
        t = tilts.where("tilt is not null").withColumn("_t", F.col("tilt") - F.avg("tilt").over(w))
        use = use.join(t.where(F.abs("_t") > 1e-15).select("date", "factor", "_t"), ["date", "factor"])
    x = use.groupBy("date", "ticker").agg(F.sum(F.col("load") * F.col("_t")).alias("_w"))
    return x.select("date", "ticker", ratio(F.col("_w"), F.sum(F.abs("_w")).over(Window.partitionBy("date"))).alias("w"))
