"""Strategy books: each is a function from a panel to (date, ticker, w); only the engine in `operators/pnl.py` turns weights into P&L."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, clip, ratio, rolling_median
from panelweave.operators import cross_section as C
from panelweave.operators import rolling as W
from panelweave.operators import state as P

BOOKS: dict[str, Callable[..., DataFrame]] = {}


def register_book(name: str, build: Callable[..., DataFrame]) -> None:
    """Add a book under a name of its own."""
    if name in BOOKS:
        raise ValueError(f"{name} is taken")
    BOOKS[name] = build


def buy_and_hold(market: DataFrame) -> DataFrame:
    return market.where("close is not null").select("date", F.lit("MKT").alias("ticker"), F.lit(1.0).alias("w"))


def sma_gate(market: DataFrame, n: int = 40, leverage: float = 2.0) -> DataFrame:
    """Leveraged above the moving average, else nothing."""
    m = W.sma_ratio(market.withColumn("ticker", F.lit("MKT")), n)
    return m.where("sma is not null").select("date", "ticker", F.when(F.col("above") > 0, leverage).otherwise(0.0).alias("w"))


def trend_gate(market: DataFrame, n: int = 40, width: float = 0.01, leverage: float = 2.0) -> DataFrame:
    """As sma_gate with a band in which the gate stays as it was."""
    m = W.sma_ratio(market.withColumn("ticker", F.lit("MKT")), n)
    m = P.hysteresis(m, F.col("above") > width, F.col("above") < -width)
    return m.where("sma is not null").select("date", "ticker", (F.coalesce("gate", F.lit(0)) * leverage).alias("w"))


def vol_managed(market: DataFrame, n: int = 13, target: float = 0.01, per_year: int = 52, cap: float = 2.0, width: float = 0.1) -> DataFrame:
    """Target over trailing volatility, capped, moved only when it is off by more than the width."""
    m = W.realized_vol(market.withColumn("ticker", F.lit("MKT")), n, per_year)
    return P.tolerance_band(m.withColumn("target", clip(ratio(F.lit(target), F.col("vol")), 0.0, cap)), width).select("date", "ticker", F.col("held").alias("w"))


def dual_momentum(panel: DataFrame, long: int = 52, otherwise: str = "CASH") -> DataFrame:
    """The region with the best momentum if it is positive, else cash."""
    level = panel.groupBy("date", F.col("sector").alias("ticker")).agg(F.avg("ret").alias("ret"))
    w = by("ticker").rowsBetween(-(long - 1), 0)
    level = level.withColumn("mom", F.when(F.count("ret").over(w) == long, F.round(F.exp(F.sum(F.log1p("ret")).over(w)) - 1, 9)))
    return C.argmax_pick(level, 0.0, otherwise).select("date", "ticker", F.lit(1.0).alias("w"))


def momentum_concentrated(panel: DataFrame, market: DataFrame, k: int = 5, long: int = 13, skip: int = 1, vol: int = 8, parts: int = 4, target: float = 0.02, low: float = 0.5, high: float = 2.0, sma: int = 40) -> DataFrame:
    """The k best members by momentum, weighted by inverse volatility, spread over tranches that refresh in turn; scaled to a volatility target, not levered while the market is under its average."""
    x = W.realized_vol(W.momentum(panel, long, skip), vol, 52).where("member")
    top = C.topk_inverse_vol(x, k).withColumn("_n", F.count("*").over(Window.partitionBy("date"))).where(F.col("_n") == k)
    days = panel.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date"))).join(top.select("date").distinct().withColumn("_picked", F.lit(0.0)), "date", "left")  # one row per date
    grid = panel.select("date", "ticker", "ret").join(days, "date").join(top.select("date", "ticker", "w"), ["date", "ticker"], "left")
    base = P.tranches(grid.withColumn("w", F.coalesce("w", "_picked")), parts)  # a date without enough names leaves its tranche as it was
    earned = base.withColumn("_e", F.lag("w").over(by("ticker")) * F.col("ret")).groupBy("date").agg(F.sum("_e").alias("net"))
    own = F.when(F.count("net").over(Window.orderBy("date").rowsBetween(-(vol - 1), 0)) == vol, F.stddev_samp("net").over(Window.orderBy("date").rowsBetween(-(vol - 1), 0))) * F.sqrt(F.lit(52.0))
    lev = earned.withColumn("_v", F.round(own, 12)).withColumn("lev", F.coalesce(clip(ratio(F.lit(target), F.col("_v")), low, high), F.lit(1.0)))
    bear = W.sma_ratio(market.withColumn("ticker", F.lit("MKT")), sma).select("date", F.coalesce(F.col("above") < 0, F.lit(False)).alias("_bear"))
    out = base.select("date", "ticker", "w").join(lev.select("date", "lev"), "date").join(bear, "date")
    out = out.withColumn("w", F.col("w") * F.when(F.col("_bear"), F.least("lev", F.lit(1.0))).otherwise(F.col("lev")))
    gross = F.sum(F.abs("w")).over(Window.partitionBy("date"))
    return out.withColumn("w", F.when(gross > high, F.col("w") * high / gross).otherwise(F.col("w"))).where("w <> 0").select("date", "ticker", "w")


def trend_multi(panel: DataFrame, long: int = 26, vol: int = 13) -> DataFrame:
    """Sign of momentum times inverse volatility, gross one."""
    x = W.realized_vol(W.momentum(panel, long, 0), vol, 52).where("mom is not null and vol > 0")
    raw = F.signum("mom") / F.col("vol")
    return x.select("date", "ticker", ratio(raw, F.sum(F.abs(raw)).over(Window.partitionBy("date"))).alias("w"))


def gap_events(panel: DataFrame, n: int = 13, z: float = 1.5, calm: int = 8, busy: float = 1.0, hold: int = 4) -> DataFrame:
    """panel with active: 1 on the dates 1..hold after a member's return of z trailing deviations on busy times its median volume, while there is a price."""
    before = by("ticker").rowsBetween(-n, -1)
    x = panel.withColumn("_s", F.when(F.count("ret").over(before) == n, F.stddev_samp("ret").over(before)))
    x = x.withColumn("_v", F.lag(rolling_median("volume", calm, "ticker")).over(by("ticker")))
    event = F.col("member") & (F.col("ret") > z * F.col("_s")) & (F.col("volume") >= busy * F.col("_v"))
    return P.event_hold(x, F.coalesce(event, F.lit(False)), hold).withColumn("active", F.when(F.col("close").isNotNull(), F.col("active")).otherwise(0))


def gap_drift(panel: DataFrame, cap: float = 0.2, gross: float = 1.5) -> DataFrame:
    """Names held for some dates after a large positive return on large volume, equally up to a cap; what is idle is in the market."""
    x = gap_events(panel).select("date", "ticker", "active").withColumn("_n", F.sum("active").over(Window.partitionBy("date")))
    names = x.where("active = 1").select("date", "ticker", (F.least(1 / F.col("_n"), F.lit(cap)) * gross).alias("w"))
    idle = x.groupBy("date").agg(F.first("_n").alias("_n")).select("date", F.lit("MKT").alias("ticker"), (gross - F.when(F.col("_n") > 0, F.least(F.lit(1.0), F.col("_n") * cap)).otherwise(0.0) * gross).alias("w"))
    return names.unionByName(idle)


for _name, _build in {
    "bench_buyhold": buy_and_hold, "bench_sma_2x": sma_gate, "trend_gated_2x": trend_gate, "vol_managed": vol_managed, "dual_momentum": dual_momentum, "momentum_concentrated": momentum_concentrated, "tsmom_multi_asset": trend_multi, "gap_drift": gap_drift,
}.items():
    register_book(_name, _build)
