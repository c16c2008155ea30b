"""Overlays, blends, perturbed inputs and summaries of books; only lagged, costed weights earn, as in `pnl`."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelweave.functions.columns import by, ratio, rolling_std, trailing
from panelweave.operators import inference as I
from panelweave.operators import metrics as M
from panelweave.operators import pnl as L
from panelweave.operators import state as P

PAST = (Window.unboundedPreceding, 0)


def breadth_ratio(panel: DataFrame, bench: DataFrame, n: int) -> DataFrame:
    """(date, ticker, breadth): change over n rows of each close in terms of the bench's close."""
    x = panel.join(bench.select("date", F.col("close").alias("_b")), "date").withColumn("_q", ratio(F.col("close"), F.col("_b")))
    return x.select("date", "ticker", (ratio(F.col("_q"), F.lag("_q", n).over(by("ticker"))) - 1).alias("breadth"))


def tolerance_band_joint(df: DataFrame, width: float, key: str = "ticker") -> DataFrame:
    """held of the risky leg and rest of the other: nothing while the gate is shut, the target at once when it opens, then only moves beyond width.

    State: the risky leg, -1 while shut.
    """

    def step(s: float, target: float | None, gate: int | None) -> float:
        if gate == 0:
            return -1.0
        return target if gate == 1 and target is not None and (s < 0 or abs(target - s) > width) else s

    out = P.fold(df, [key], ["target", "gate"], -1.0, step, "s", DoubleType())
    return out.select(key, "date", F.greatest("s", F.lit(0.0)).alias("held"), F.when(F.col("s") < 0, 0.0).otherwise(1 - F.col("s")).alias("rest"))


def row_band(weights: DataFrame, dates: DataFrame, width: float) -> DataFrame:
    """(book, date, ticker, w): the whole row of targets is adopted when it is further than width (sum of absolute differences) from the one held.

    A fold over a book's dates, in vectors over its names.
    """
    rows = weights.select("book").distinct().crossJoin(F.broadcast(dates)).join(weights, ["book", "date"], "left")  # a row without a ticker on dates without targets

    def step(held: np.ndarray, key: str, date: object, ids: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
        want = np.zeros_like(held)
        want[ids] = np.nan_to_num(values[0])
        held = want if np.abs(want - held).sum() > width else held
        at = np.flatnonzero(held)
        return held, (at, held[at])

    return P.named(P.fold_vectors(rows, "book", ["w"], np.zeros, step, P.HELD), rows).select("book", "date", "ticker", "w")


def overlay_cost(weights: DataFrame, betas: DataFrame, bps: float) -> DataFrame:
    """(book, date, overlay, cost): the hedge sum of w times yesterday's beta, and twice the cost of its changes name by name."""
    b = betas.select("date", "ticker", F.lag("beta").over(by("ticker")).alias("_b"))
    x = weights.join(b, ["date", "ticker"], "left").withColumn("_o", F.col("w") * F.coalesce("_b", F.lit(0.0)))
    x = x.withColumn("_d", F.abs(F.col("_o") - F.coalesce(F.lag("_o").over(by("book", "ticker")), F.lit(0.0))))
    return x.groupBy("book", "date").agg(F.sum("_o").alias("overlay"), (F.sum("_d") * (bps * 2 / 1e4)).alias("cost"))


def pair_pnl(positions: DataFrame, returns: DataFrame, bps: float) -> DataFrame:
    """(pair, date, net): yesterday's position times the difference of the legs' returns, less the cost of both legs' changes."""
    r = returns.select("date", "ticker", "ret")
    x = positions.join(r.select("date", F.col("ticker").alias("a"), F.col("ret").alias("ra")), ["date", "a"], "left").join(r.select("date", F.col("ticker").alias("b"), F.col("ret").alias("rb")), ["date", "b"], "left")
    w = by("pair")
    x = x.withColumn("_h", F.coalesce(F.lag("position").over(w), F.lit(0)))
    x = x.withColumn("_t", F.abs(F.col("_h") - F.coalesce(F.lag("_h").over(w), F.lit(0))))
    return x.select("pair", "date", (F.coalesce(F.col("_h") * (F.col("ra") - F.col("rb")), F.lit(0.0)) - F.col("_t") * (2 * bps / 1e4)).alias("net"))


def harness(weights: DataFrame, returns: DataFrame, dates: DataFrame, classes: DataFrame, cap: float, least: int) -> DataFrame:
    """(book, date, gross, cost, net, names): gross capped, weights lagged, each name charged its class's bps when it becomes held, entry
    included; the return is null on dates with fewer than `least` held names priced. classes: (ticker, bps), one row per name."""
    h = L.held(L.gross_cap(weights, cap).select("book", "date", "ticker", "w"), dates).join(classes, "ticker").join(returns, ["date", "ticker"], "left")
    names = F.count_if((F.col("held") != 0) & F.col("ret").isNotNull())
    out = h.groupBy("book", "date").agg(F.sum(F.col("held") * F.col("ret")).alias("gross"), F.sum(F.col("traded") * F.col("bps") / 1e4).alias("cost"), names.alias("names"))
    out = out.withColumn("gross", F.when(F.col("names") >= least, F.col("gross")))
    return out.select("book", "date", "gross", "cost", (F.col("gross") - F.col("cost")).alias("net"), "names")


def summary_block(nets: DataFrame, exposures: DataFrame, n: int) -> DataFrame:
    """Per book: growth a year, volatility, worst and best n rows, turnover and cost a year, and the mean gross exposure."""
    w = trailing(n, "book")
    x = nets.withColumn("_y", F.when(F.count("net").over(w) == n, F.exp(F.sum(F.log1p("net")).over(w)) - 1))
    g = x.groupBy("book").agg((F.exp(F.sum(F.log1p("net")) * n / F.count("net")) - 1).alias("cagr"), (F.stddev_samp("net") * F.sqrt(F.lit(float(n)))).alias("vol"), F.min("_y").alias("worst"), F.max("_y").alias("best"), (F.avg("turnover") * n).alias("turnover"), (F.avg("cost") * n).alias("cost_drag"))
    e = exposures.groupBy("book", "date").agg(F.sum(F.abs("held")).alias("_g")).groupBy("book").agg(F.avg("_g").alias("avg_gross"))
    return g.join(e, "book")


def exposure_matched(nets: DataFrame, exposures: DataFrame, market: DataFrame) -> DataFrame:
    """(book, date, bench, excess): the market held at the book's mean gross exposure, and what the book earned beyond it."""
    e = exposures.groupBy("book", "date").agg(F.sum(F.abs("held")).alias("_g")).groupBy("book").agg(F.avg("_g").alias("level"))
    x = nets.join(e, "book").join(market.select("date", F.coalesce("ret", F.lit(0.0)).alias("_m")), "date")
    return x.select("book", "date", (F.col("level") * F.col("_m")).alias("bench"), (F.col("net") - F.col("level") * F.col("_m")).alias("excess"))


def mark_by_bucket(weights: DataFrame, returns: DataFrame, dates: DataFrame, floor: float) -> DataFrame:
    """(book, date, bucket, names, pnl, floored): yesterday's longs and shorts marked apart; floored bounds each name's return from below."""
    h = L.held(weights, dates).where("held <> 0").join(returns, ["date", "ticker"], "left")
    low = F.when(F.col("ret").isNotNull(), F.greatest(F.col("ret"), F.lit(floor)))
    return h.groupBy("book", "date", F.when(F.col("held") > 0, "long").otherwise("short").alias("bucket")).agg(F.count("*").alias("names"), F.coalesce(F.sum(F.col("held") * F.col("ret")), F.lit(0.0)).alias("pnl"), F.coalesce(F.sum(F.col("held") * low), F.lit(0.0)).alias("floored"))


def perturbed(panel: DataFrame, one_in: int) -> DataFrame:
    """The panel once as it is and once per perturbation (`variant`): closes masked by a scrambled number, membership one row late,
    membership only where it also held a row before. Returns are computed anew in each."""
    w = by("ticker")
    x = panel.withColumn("_p", F.row_number().over(w).cast("long")).withColumn("_m", F.coalesce(F.lag("member").over(w), F.lit(False)))
    x = x.withColumn("variant", F.explode(F.array(*[F.lit(v) for v in ("base", "masked", "late", "strict")])))
    gone = (F.col("variant") == "masked") & (I.scramble(F.col("_p"), F.lit(3).cast("long")) % one_in == 0)
    x = x.withColumn("close", F.when(~gone, F.col("close"))).withColumn("member", F.when(F.col("variant") == "late", F.col("_m")).when(F.col("variant") == "strict", F.col("_m") & F.col("member")).otherwise(F.col("member")))
    return x.withColumn("ret", F.col("close") / F.lag("close").over(by("variant", "ticker")) - 1).drop("_p", "_m")


def random_lag(weights: DataFrame, one_in: int) -> DataFrame:
    """(book, ticker, date, w): on scrambled dates the weights of the date before stand."""
    w = by("book", "ticker")
    late = I.scramble(F.col("pos"), F.lit(11).cast("long")) % one_in == 0
    return weights.select("book", "ticker", "date", F.when(late, F.coalesce(F.lag("w").over(w), F.lit(0.0))).otherwise(F.col("w")).alias("w"))


def bracket_report(nets: DataFrame, floor: float, per_year: int) -> DataFrame:
    """Per book: sharpe of the net, of the net bounded below, and of what the bound is worth."""
    low = F.greatest(F.col("net"), F.lit(floor))
    return nets.groupBy("book").agg(F.count("*").alias("n"), M.sharpe("net", per_year).alias("full"), M.sharpe(low, per_year).alias("floored"), M.sharpe(low - F.col("net"), per_year).alias("premium"), F.sum(low - F.col("net")).alias("drag"))


def ensemble(nets: DataFrame, calendar: DataFrame, n: int, target: float, per_year: int, cap: float) -> DataFrame:
    """(date, blend, lev, net): sleeves by inverse volatility set on each month's first date and held from the next row, then scaled to a target."""
    x = nets.join(calendar.select("date", "month_first"), "date").withColumn("_i", ratio(F.lit(1.0), rolling_std("net", n, "book")))
    x = x.withColumn("_w", ratio(F.col("_i"), F.sum("_i").over(Window.partitionBy("date"))))
    x = x.withColumn("_k", F.last(F.when(F.col("month_first"), F.coalesce("_w", F.lit(0.0))), ignorenulls=True).over(by("book").rowsBetween(Window.unboundedPreceding, -1)))
    b = x.groupBy("date").agg(F.sum(F.coalesce("_k", F.lit(0.0)) * F.col("net")).alias("net")).withColumn("book", F.lit("blend"))
    out = L.vol_target(b, target, n, per_year, 0.0, cap)
    return out.select("date", F.col("net").alias("blend"), "lev", (F.col("lev") * F.col("net")).alias("net"))


def trend_factor(panel: DataFrame, n: int, skip: int, vol: int) -> DataFrame:
    """(date, trend): mean over sectors of the sign of a skipped trailing sum times the return, in units of yesterday's volatility."""
    s = panel.groupBy("sector", "date").agg(F.avg("ret").alias("ret"))
    w = by("sector")
    s = s.withColumn("_s", F.when(F.count("ret").over(w.rowsBetween(-n, -skip)) == n - skip + 1, F.signum(F.round(F.sum("ret").over(w.rowsBetween(-n, -skip)), 12))))
    s = s.withColumn("_d", rolling_std("ret", vol, "sector")).withColumn("_v", F.lag("_d").over(w))
    return s.groupBy("date").agg(F.avg(F.col("_s") * F.col("ret") / F.when(F.col("_v") > 1e-12, F.col("_v"))).alias("trend"))


def monthly_abs_beta(betas: DataFrame) -> DataFrame:
    """(month, names, abs_beta): mean absolute beta on each month's last date that has any."""
    x = betas.where("beta is not null").withColumn("month", F.to_date(F.date_trunc("month", "date")))
    x = x.withColumn("_l", F.max("date").over(Window.partitionBy("month"))).where("date = _l")
    return x.groupBy("month").agg(F.count("*").alias("names"), F.avg(F.abs("beta")).alias("abs_beta"))


def incremental_value(nets: DataFrame, control: str, per_year: int) -> DataFrame:
    """(book, how, sharpe, vol, dd, gain): the control mixed half and half with each other book, by equal capital or inverse volatility, both
    against the control at the mix's volatility."""
    c = nets.where(F.col("book") == control).select("date", F.col("net").alias("c"))
    x = nets.where(F.col("book") != control).select("book", "date", F.col("net").alias("x")).join(c, "date")
    m = Window.partitionBy("book")
    share = ratio(F.stddev_samp("c").over(m), F.stddev_samp("c").over(m) + F.stddev_samp("x").over(m))
    x = x.withColumn("_h", share).withColumn("how", F.explode(F.array(F.lit("equal"), F.lit("inverse_vol")))).withColumn("_w", F.when(F.col("how") == "equal", 0.5).otherwise(F.col("_h")))
    x = x.withColumn("net", F.col("_w") * F.col("x") + (1 - F.col("_w")) * F.col("c"))
    w = Window.partitionBy("book", "how").orderBy("date").rowsBetween(*PAST)
    x = x.withColumn("_n", F.sum("net").over(w)).withColumn("_t", F.max("_n").over(w))
    g = x.groupBy("book", "how").agg(M.sharpe("net", per_year).alias("sharpe"), (F.stddev_samp("net") * F.sqrt(F.lit(float(per_year)))).alias("vol"), F.min(F.col("_n") - F.greatest("_t", F.lit(0.0))).alias("dd"), F.avg("net").alias("_m"), F.avg("c").alias("_c"), F.stddev_samp("net").alias("_s"), F.stddev_samp("c").alias("_sc"))
    return g.select("book", "how", "sharpe", "vol", "dd", ((F.col("_m") - F.col("_c") * ratio(F.col("_s"), F.col("_sc"))) * per_year).alias("gain"))


def orthogonality(nets: DataFrame, control: str, limits: dict[str, float], lags: int) -> DataFrame:
    """Per other book: correlation with the control, on the control's falling and worst dates too, R2, alpha's t, and which gate binds."""
    c = nets.where(F.col("book") == control).select("date", F.col("net").alias("c"))
    x = nets.where(F.col("book") != control).select("book", "date", F.col("net").alias("x")).join(c, "date")
    x = x.withColumn("_q", F.percent_rank().over(Window.partitionBy("book").orderBy("c", "date")))
    part = lambda ok: F.corr(F.when(ok, F.col("x")), F.when(ok, F.col("c")))
    g = x.groupBy("book").agg(F.count("*").alias("n"), F.corr("x", "c").alias("corr"), part(F.col("c") < 0).alias("corr_down"), part(F.col("_q") < 0.1).alias("corr_worst"))
    fit = I.nw_ols(x, ["book"], "x", ["c"], lags).where("term = 'const'").select("book", "r2", F.col("t").alias("alpha_t"))
    g = g.join(fit, "book")
    fails = F.array_compact(F.array(*[F.when(F.abs(k) > v, F.lit(k)) for k, v in limits.items()]))
    g = g.withColumn("binding", F.get(fails, F.lit(0)))
    outcome = F.when(F.col("binding").isNotNull() & (F.col("alpha_t") > 2), "dependent_alpha").when(F.col("binding").isNotNull(), "redundant").when(F.col("alpha_t") > 2, "independent_alpha").otherwise("independent")
    return g.withColumn("outcome", outcome)
