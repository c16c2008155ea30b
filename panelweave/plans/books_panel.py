"""Books over the panel that need more than weights by a window: the residual book, and folds over a book's dates."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, ratio
from panelweave.operators import bars as B
from panelweave.operators import exposure as E
from panelweave.operators import factors as N
from panelweave.operators import pnl as L
from panelweave.operators import rolling as W
from panelweave.operators import state as P
from panelweave.operators import universe as U
from panelweave.plans.books import gap_events


def residual_positions(factor: DataFrame, n: int = 13, entry: float = 1.25, leave: float = 0.5, floor: float = 20_000.0, blackout: Column | None = None) -> DataFrame:
    """Banded reversion positions of the members, without thin names and without entries inside a blackout."""
    s = P.band_positions(W.s_score(W.residual(B.dollar_adv(factor, 8), n), n), entry, leave)
    s = U.liquidity_filter(s.withColumn("position", F.when(F.col("member"), F.col("position")).otherwise(0)), floor)
    return s if blackout is None else P.blackout_entries(s.withColumn("mask", blackout))


def run_residual(factor: DataFrame, skip: int = 1, bps: float = 5.0, name: float = 0.08, sector: float = 0.1, **rules) -> DataFrame:  # noqa: ANN003
    """(date, gross, cost, net) of the residual book: capped weights earn hedged returns 1 + skip dates later; names' and the hedge's turnover cost; from the first date with a net on."""
    w = L.name_sector_cap(L.to_weights(residual_positions(factor, **rules)), name, sector)
    t = by("ticker")
    x = w.withColumn("_h", F.lag("w", 1 + skip).over(t)).withColumn("_t", F.abs(F.col("w") - F.lag("w").over(t)))
    day = x.groupBy("date").agg(F.coalesce(F.sum(F.col("_h") * F.col("hedged")), F.lit(0.0)).alias("gross"), F.coalesce(F.sum("_t"), F.lit(0.0)).alias("_t"))
    hedge = E.overlay_cost(w.select(F.lit("residual").alias("book"), "date", "ticker", "w"), w.select("date", "ticker", "beta"), bps).select("date", F.col("cost").alias("_o"))
    day = day.join(hedge, "date").withColumn("cost", F.col("_t") * (2 * bps / 1e4) + F.col("_o")).withColumn("net", F.col("gross") - F.col("cost"))
    live = F.sum((F.abs("net") > 1e-15).cast("int")).over(Window.orderBy("date"))  # one row per date
    return day.withColumn("_l", live).where("_l > 0").select("date", "gross", "cost", "net")


def _reset(held: np.ndarray, target: float, ids: np.ndarray, band: float) -> np.ndarray:
    """Only the names of ids are held; those off the target by more than the band, or new, are set to it."""
    own = held[ids]
    out = np.zeros_like(held)
    out[ids] = np.where((own <= 0) | (np.abs(own / target - 1) > band), target, own)
    return out


def _drifted(held: np.ndarray, ids: np.ndarray, ret: np.ndarray) -> np.ndarray:
    """What is held after the date's returns; a null one moves nothing, a name without a row is gone."""
    out = np.zeros_like(held)
    out[ids] = held[ids] * (1 + np.nan_to_num(ret))
    return out


def _members(panel: DataFrame) -> DataFrame:
    return panel.select(F.lit("book").alias("key"), "date", "ticker", "ret", (F.col("member") & F.col("close").isNotNull()).cast("double").alias("ok"))


def equal_weight_band(panel: DataFrame, band: float = 0.2) -> DataFrame:
    """Members with a price, equally weighted; weights drift with returns, those beyond the band are reset, the sum stays one. A fold over dates, in vectors over the names."""

    def step(held: np.ndarray, key: str, date: object, ids: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, tuple]:
        ret, ok = values
        names = ids[ok > 0]
        held = _reset(_drifted(held, ids, ret), 1 / max(len(names), 1), names, band)
        held = held / (held.sum() or 1.0)
        at = np.flatnonzero(held)
        return held, (at, held[at])

    rows = _members(panel)
    return P.named(P.fold_vectors(rows, "key", ["ret", "ok"], np.zeros, step, P.HELD), rows).select("date", "ticker", "w")


def levered_gate(panel: DataFrame, index: DataFrame, high: float, back: int = 3, band: float = 0.2, cap: float = 2.0) -> DataFrame:
    """Equal weights at twice the money, once while the index (date, v) has not been below `high` for `back` dates; a flip of the gate or the band resets names. A fold over dates, in vectors over the names."""

    def step(state: tuple, key: str, date: object, ids: np.ndarray, values: list[np.ndarray]) -> tuple[tuple, tuple | None]:
        held, level, below, known = state
        ret, ok, gauge = values
        v = gauge[0] if len(gauge) and not np.isnan(gauge[0]) else None
        earned = 1 + float(held[ids] @ np.nan_to_num(ret))
        if earned > 0.05:
            held = _drifted(held, ids, ret) / earned
        if level is None:
            level = 1.0 if v is not None and v >= high else cap
        new = level
        if v is not None and v >= high:
            new, below = 1.0, 0
        elif v is not None and level < cap:
            below += 1
            new = cap if below >= back else level
        names = ids[ok > 0]
        if not len(names):
            return (np.zeros_like(held), level, below, np.zeros(len(held), bool)), None
        target = new / len(names)
        if new != level:
            held = np.zeros_like(held)
            held[names] = target
        else:
            held = _reset(np.where(known, held, 0.0), target, names, band)
        held = held * min(1.0, cap / np.abs(held).sum())
        known = np.zeros(len(held), bool)
        known[names] = True
        at = np.flatnonzero(held)
        return (held, new, below, known), (at, held[at])

    rows = _members(panel).join(index, "date", "left")
    start = lambda n: (np.zeros(n), None, 0, np.zeros(n, bool))
    return P.named(P.fold_vectors(rows, "key", ["ret", "ok", "v"], start, step, P.HELD), rows).select("date", "ticker", "w")


def deep_dip(factor: DataFrame, slots: int = 5, hold: int = 13, n: int = 13, entry: float = -1.25, leave: float = 0.0, gross: float = 1.5) -> DataFrame:
    """The deepest members in fixed slots a date after the signal, never without a price; what is idle is in the market."""
    s = W.s_score(W.residual(factor, n), n)
    cells = s.select("date", "ticker", F.when(F.col("member") & (F.col("s") <= entry), F.col("s")).alias("depth"), F.coalesce(F.col("s") >= leave, F.lit(False)).alias("leave"), F.col("close").isNotNull().alias("priced"))
    picked = N.slot_grid(cells, [slots], [hold]).select("date", "ticker", F.lit(1).alias("_in"))
    x = factor.select("date", "ticker", "close").join(picked, ["date", "ticker"], "left")
    x = x.withColumn("w", F.when(F.col("close").isNotNull() & F.lag("_in").over(by("ticker")).isNotNull(), F.lit(gross / slots)))
    names = x.where("w is not null").select("date", "ticker", "w")
    return names.unionByName(x.groupBy("date").agg((gross - F.coalesce(F.sum("w"), F.lit(0.0))).alias("w")).select("date", F.lit("MKT").alias("ticker"), "w"))


def composite(panel: DataFrame, index: DataFrame, core: float = 1.0, drift: float = 0.5, base: float = 0.3, cap: float = 0.05, high: float = 1.2, low: float = 1.0, back: int = 3, gross: float = 2.0) -> DataFrame:
    """Equal weights with a band, names after gaps with the rest in the market, and the market; halved while the index gate is shut, under a gross cap."""
    a = equal_weight_band(panel).withColumn("w", F.col("w") * core)
    x = gap_events(panel).where("active = 1").select("date", "ticker")
    b = x.withColumn("w", F.least(F.lit(cap), 1 / F.count("*").over(Window.partitionBy("date"))) * drift)
    used = b.groupBy("date").agg(F.sum("w").alias("_u"))
    rest = panel.select("date").distinct().join(used, "date", "left").select("date", F.lit("MKT").alias("ticker"), (F.greatest(drift - F.coalesce("_u", F.lit(0.0)), F.lit(0.0)) + base).alias("w"))
    w = a.unionByName(b).unionByName(rest).groupBy("date", "ticker").agg(F.sum("w").alias("w"))
    gate = P.halving_gate(index.withColumn("ticker", F.lit("index")), high, low, back).select("date", "exposure")
    w = w.join(gate, "date").withColumn("w", F.col("w") * F.col("exposure"))
    size = F.sum(F.abs("w")).over(Window.partitionBy("date"))
    return w.withColumn("w", F.when(size > gross, F.col("w") * gross / size).otherwise(F.col("w"))).select("date", "ticker", "w")


def monthly_min_variance(weights: DataFrame, dates: DataFrame) -> DataFrame:
    """weights: (month, ticker, w). The weights of a month's window are held on all dates of the month."""
    return dates.select("date", F.to_date(F.date_trunc("month", "date")).alias("month")).join(weights, "month").select("date", "ticker", "w")


def walk_forward_pairs(panel: DataFrame, calendar: DataFrame, formation: int = 26, trading: int = 13, n: int = 5, entry: float = 1.25, leave: float = 0.5, bps: float = 10.0) -> DataFrame:
    """(date, pairs, net): per window the n same-sector pairs of closest normalised paths over its formation dates, traded in the following dates by a band on the spread's distance from its
    formation mean in formation deviations; positions start flat in each window. calendar: (date, pos)."""
    at = F.col("pos") - 1
    last = calendar.agg(F.max("pos").alias("_last"))
    spans = last.where(F.col("_last") > formation).select(F.explode(F.sequence(F.lit(0), F.floor((F.col("_last") - 1 - formation) / trading).cast("int"))).alias("k"))  # one row per window
    days = calendar.join(F.broadcast(spans), (at >= F.col("k") * trading) & (at < F.col("k") * trading + formation + trading))
    days = days.select("k", "date", (at < F.col("k") * trading + formation).alias("forming"))
    x = panel.where("close is not null").select("date", "ticker", "sector", "close", "ret").join(F.broadcast(days), "date")
    first = F.first("close").over(Window.partitionBy("k", "ticker").orderBy("date"))
    form = x.where("forming").withColumn("_p", F.col("close") / first)
    legs = lambda d, value: d.select("k", "date", "sector", F.col("ticker").alias("a"), F.col(value).alias("x")).join(d.select("k", "date", "sector", F.col("ticker").alias("b"), F.col(value).alias("y")), ["k", "date", "sector"]).where("a < b")
    near = legs(form, "_p").groupBy("k", "a", "b").agg(F.round(F.avg(F.pow(F.col("x") - F.col("y"), F.lit(2))), 9).alias("ssd"))
    near = near.withColumn("_r", F.row_number().over(Window.partitionBy("k").orderBy("ssd", "a", "b"))).where(F.col("_r") <= n).select("k", "a", "b")
    side = lambda d, c: d.select("k", "date", F.col("ticker").alias(c), F.log("close").alias(f"l{c}"), F.col("ret").alias(f"r{c}"), "forming")
    both = near.join(side(x, "a"), ["k", "a"]).join(side(x, "b").drop("forming"), ["k", "date", "b"]).withColumn("spread", F.col("la") - F.col("lb"))
    fit = both.where("forming").groupBy("k", "a", "b").agg(F.avg("spread").alias("_m"), F.stddev_samp("spread").alias("_s"))
    z = both.where("not forming").join(fit, ["k", "a", "b"]).withColumn("z", ratio(F.col("spread") - F.col("_m"), F.col("_s"))).withColumn("pair", F.concat_ws("/", F.col("k").cast("string"), "a", "b"))
    p = P.band_positions(z, entry, leave, value="z", key="pair").withColumn("_h", F.coalesce(F.lag("position").over(by("pair")), F.lit(0)))
    p = p.withColumn("_t", F.coalesce(F.abs(F.col("position") - F.col("_h")), F.lit(0))).withColumn("_t", F.when(F.lag("date").over(by("pair")).isNull(), 0).otherwise(F.col("_t")))
    net = F.coalesce(F.col("_h") * (F.col("ra") - F.col("rb")), F.lit(0.0)) - F.col("_t") * (2 * bps / 1e4)
    return p.groupBy("date").agg(F.count("*").alias("pairs"), F.avg(net).alias("net"))
