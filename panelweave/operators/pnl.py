"""Exposure filters and P&L: only lagged, costed weights earn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, clip, ratio


def to_weights(positions: DataFrame) -> DataFrame:
    return positions.withColumn("w", F.coalesce(ratio(F.col("position").cast("double"), F.sum(F.abs("position")).over(Window.partitionBy("date")).cast("double")), F.lit(0.0)))


def name_sector_cap(weights: DataFrame, name: float, sector: float) -> DataFrame:
    """Clip each name, scale sectors whose net exceeds the cap, bring the gross back to one: one pass."""
    w = weights.withColumn("w", clip(F.col("w"), -name, name))
    net = F.abs(F.sum("w").over(Window.partitionBy("date", "sector")))
    w = w.withColumn("w", F.when(net > sector, F.col("w") * sector / net).otherwise(F.col("w")))
    return w.withColumn("w", F.coalesce(ratio(F.col("w"), F.sum(F.abs("w")).over(Window.partitionBy("date"))), F.lit(0.0)))


def gross_cap(weights: DataFrame, cap: float) -> DataFrame:
    """Book dates above the gross cap scaled down to it; capped marks them."""
    gross = F.sum(F.abs("w")).over(Window.partitionBy("book", "date"))
    return weights.withColumn("_g", gross).withColumn("capped", F.col("_g") > cap).withColumn("w", F.when(F.col("capped"), F.col("w") * cap / F.col("_g")).otherwise(F.col("w"))).drop("_g")


def vol_target(nets: DataFrame, target: float, n: int, per_year: int, low: float, high: float) -> DataFrame:
    """Leverage target / trailing vol of the book, lagged one date and clipped; one before it is known."""
    vol = F.when(F.count("net").over(by("book").rowsBetween(-(n - 1), 0)) == n, F.stddev_samp("net").over(by("book").rowsBetween(-(n - 1), 0))) * F.sqrt(F.lit(float(per_year)))
    nets = nets.withColumn("_v", vol)
    return nets.withColumn("lev", F.coalesce(clip(ratio(F.lit(target), F.lag("_v").over(by("book"))), low, high), F.lit(1.0))).drop("_v")


def held(weights: DataFrame, dates: DataFrame, lag: int = 1) -> DataFrame:
    """(book, date, ticker, w, held): weights on every date of the calendar, zero where absent, and those of `lag` dates before."""
    grid = weights.select("book", "ticker").distinct().crossJoin(dates)
    out = grid.join(weights, ["book", "date", "ticker"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    w = by("book", "ticker")
    return out.withColumn("held", F.coalesce(F.lag("w", lag).over(w), F.lit(0.0))).withColumn("_b", F.coalesce(F.lag("w", lag + 1).over(w), F.lit(0.0))).withColumn("traded", F.abs(F.col("held") - F.col("_b"))).drop("_b")


def backtest(weights: DataFrame, returns: DataFrame, dates: DataFrame, cost_bps: float = 10.0, sides: float = 1.0, lag: int = 1) -> DataFrame:
    """(book, date, gross, cost, net, turnover). Yesterday's weights earn today; turnover is charged when weights become held, entry included."""
    h = held(weights, dates, lag).join(returns, ["date", "ticker"], "left")
    out = h.groupBy("book", "date").agg(F.coalesce(F.sum(F.col("held") * F.col("ret")), F.lit(0.0)).alias("gross"), F.sum("traded").alias("turnover"))
    return out.withColumn("cost", F.col("turnover") * (cost_bps * sides / 1e4)).withColumn("net", F.col("gross") - F.col("cost")).select("book", "date", "gross", "cost", "net", "turnover")


def cost_scenarios(nets: DataFrame, bps: list[float], base_bps: float) -> DataFrame:
    """Each book repriced under each cost: (book, bps, total, mean_net). The grid is a handful of literals."""
    grid = nets.sparkSession.createDataFrame([(float(b),) for b in bps], "bps double")
    x = nets.crossJoin(F.broadcast(grid)).withColumn("net", F.col("gross") - F.col("cost") * F.col("bps") / base_bps)
    return x.groupBy("book", "bps").agg(F.sum("net").alias("total"), F.avg("net").alias("mean_net"))


def equal_weight_net(positions: DataFrame, cost_bps: float, sides: float = 2.0) -> DataFrame:
    """Lagged positions over their lagged count, less cost on what changed; leading zeros are trimmed."""
    w = by("ticker")
    p = positions.withColumn("_h", F.coalesce(F.lag("position").over(w), F.lit(0))).withColumn("_d", F.coalesce(F.abs(F.col("_h") - F.lag("_h").over(w)), F.lit(0)))
    out = p.groupBy("date").agg(F.sum(F.abs("_h")).alias("n"), F.coalesce(F.sum(F.col("_h") * F.col("ret")), F.lit(0.0)).alias("g"), F.sum("_d").alias("d"))
    out = out.select("date", "n", F.coalesce(F.try_divide(F.col("g") - F.col("d") * (cost_bps * sides / 1e4), F.col("n").cast("double")), F.lit(0.0)).alias("net"))
    live = F.sum((F.col("net") != 0).cast("int")).over(Window.orderBy("date").rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn("_l", live).where("_l > 0").drop("_l")


def timing_split(weights: DataFrame, returns: DataFrame, dates: DataFrame) -> DataFrame:
    """Per book: mean return of the mean weights (static) and of the deviations from them (timing)."""
    h = held(weights, dates).join(returns, ["date", "ticker"], "left")
    h = h.withColumn("_m", F.avg("held").over(Window.partitionBy("book", "ticker")))
    d = h.groupBy("book", "date").agg(F.coalesce(F.sum(F.col("_m") * F.col("ret")), F.lit(0.0)).alias("s"), F.coalesce(F.sum((F.col("held") - F.col("_m")) * F.col("ret")), F.lit(0.0)).alias("t"))
    return d.groupBy("book").agg(F.avg("s").alias("static"), F.avg("t").alias("timing"))


def exposure(weights: DataFrame) -> DataFrame:
    return weights.groupBy("book", "ticker").agg(F.avg(F.abs("w")).alias("mean_abs"), F.count("*").alias("days"))


def compare_books(nets: DataFrame, a: str, b: str, tolerance: float) -> DataFrame:
    """First date on which two books' nets differ by more than the tolerance, how often, and by how much at most."""
    x, y = (nets.where(F.col("book") == n).select("date", F.col("net").alias(c)) for n, c in ((a, "x"), (b, "y")))
    gap = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return x.join(y, "date", "full").withColumn("gap", gap).agg(F.min(F.when(F.col("gap") > tolerance, F.col("date"))).alias("first"), F.count_if(F.col("gap") > tolerance).alias("days"), F.max("gap").alias("largest"))


def stale_mark(panel: DataFrame) -> DataFrame:
    last = F.last("close", ignorenulls=True).over(by("ticker").rowsBetween(Window.unboundedPreceding, 0))
    return panel.withColumn("_p", last).withColumn("ret", F.col("_p") / F.lag("_p").over(by("ticker")) - 1).drop("_p")


def stress_grid(weights: DataFrame, returns: DataFrame, dates: DataFrame, cost_bps: float, delays: list[int], multiples: list[float]) -> DataFrame:
    """(book, delay, multiple, total, worst): each book under later execution and dearer trading. The grid is a handful of literals, a key of the result."""
    runs = [backtest(weights, returns, dates, cost_bps, lag=d).withColumn("delay", F.lit(d)) for d in delays]
    out = runs[0]
    for x in runs[1:]:
        out = out.unionByName(x)
    grid = F.broadcast(weights.sparkSession.createDataFrame([(float(m),) for m in multiples], "multiple double"))
    out = out.crossJoin(grid).withColumn("net", F.col("gross") - F.col("cost") * F.col("multiple"))
    return out.groupBy("book", "delay", "multiple").agg(F.sum("net").alias("total"), F.min("net").alias("worst"))


def fill_points(weights: DataFrame, panel: DataFrame, dates: DataFrame) -> DataFrame:
    """Mean gross of each book filled at the next open (open-to-open returns) and at the close after it (lag two)."""
    w = by("ticker")
    oo = panel.select("date", "ticker", (F.lead("open").over(w) / F.col("open") - 1).alias("ret"))
    cc = panel.select("date", "ticker", "ret")
    a = backtest(weights, oo, dates, 0.0).groupBy("book").agg(F.avg("gross").alias("at_open"))
    return a.join(backtest(weights, cc, dates, 0.0, lag=2).groupBy("book").agg(F.avg("gross").alias("at_close")), "book")


def target_book(positions: DataFrame) -> DataFrame:
    """The latest date's nonzero positions, equally weighted by side."""
    last = positions.agg(F.max("date").alias("date"))
    x = positions.join(F.broadcast(last), "date").where("position <> 0")  # one row
    return x.select("date", "ticker", "position", (F.col("position") / F.count("*").over(Window.partitionBy("date"))).alias("w"))


def replication(nets: DataFrame, factors: DataFrame, betas: dict[str, dict[str, float]]) -> DataFrame:
    """Each book's net less the return of its frozen factor exposures (book: factor: beta)."""
    rows = [(b, f, float(v)) for b, x in betas.items() for f, v in x.items()]
    table = F.broadcast(nets.sparkSession.createDataFrame(rows, "book string, factor string, beta double"))  # books x factors, literals
    explained = factors.join(table, "factor").groupBy("book", "date").agg(F.sum(F.col("beta") * F.col("value")).alias("explained"))
    return nets.join(explained, ["book", "date"]).select("book", "date", "explained", (F.col("net") - F.col("explained")).alias("residual"))


def stress_variants(weights: DataFrame, returns: DataFrame, calendar: DataFrame, index: DataFrame, bps: float, high: float) -> DataFrame:
    """(book, variant, total, worst, cost): the books under dearer and cheaper trading, more basis points, costs that triple while the index (date, v) is high, a later fill, half
    fills (the rest a date later) and missed trades. calendar: (date, pos)."""
    grid = weights.select("book", "ticker").distinct().crossJoin(calendar).join(weights, ["book", "date", "ticker"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    t = by("book", "ticker")
    kept = F.last(F.when((F.col("pos") * 48271) % 2147483647 % 10 != 0, F.col("w")), ignorenulls=True).over(t.rowsBetween(Window.unboundedPreceding, 0))  # a fixed tenth of the dates is missed
    arms = {"as_is": F.lag("w").over(t), "late": F.lag("w", 2).over(t), "half_fill": (F.col("w1") + F.col("w2")) / 2, "missed": F.lag("_kept").over(t)}
    grid = grid.withColumn("_kept", F.coalesce(kept, F.lit(0.0))).withColumn("w1", F.coalesce(F.lag("w").over(t), F.lit(0.0))).withColumn("w2", F.coalesce(F.lag("w", 2).over(t), F.lit(0.0)))
    each = grid.withColumns({f"_h_{k}": F.coalesce(v, F.lit(0.0)) for k, v in arms.items()})
    each = each.select("book", "date", "ticker", F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), F.col(f"_h_{k}").alias("held")) for k in arms])).alias("x")).select("book", "date", "ticker", "x.*")
    each = each.withColumn("traded", F.abs(F.col("held") - F.coalesce(F.lag("held").over(by("book", "ticker", "arm")), F.lit(0.0))))
    day = each.join(returns, ["date", "ticker"], "left").groupBy("book", "arm", "date").agg(F.coalesce(F.sum(F.col("held") * F.col("ret")), F.lit(0.0)).alias("gross"), F.sum("traded").alias("traded"))
    day = day.join(index.select("date", F.coalesce(F.lag("v").over(Window.orderBy("date")) > high, F.lit(False)).alias("_high")), "date", "left")  # one row per date
    costs = {("as_is", "base"): 1.0, ("as_is", "half"): 0.5, ("as_is", "double"): 2.0, ("as_is", "fourfold"): 4.0, ("late", "late"): 1.0, ("half_fill", "half_fill"): 1.0, ("missed", "missed"): 1.0}
    turns = [F.struct(F.lit(arm).alias("arm"), F.lit(name).alias("variant"), F.lit(m * bps).alias("_bps"), F.lit(m * bps).alias("_high_bps")) for (arm, name), m in costs.items()]
    turns += [F.struct(F.lit("as_is").alias("arm"), F.lit(name).alias("variant"), F.lit(a).alias("_bps"), F.lit(b).alias("_high_bps")) for name, a, b in (("dearer", bps + 5, bps + 5), ("stressed", bps, 3 * bps))]
    day = day.withColumn("_v", F.explode(F.filter(F.array(*turns), lambda v: v["arm"] == F.col("arm"))))
    cost = F.col("traded") * F.when(F.col("_high"), F.col("_v._high_bps")).otherwise(F.col("_v._bps")) / 1e4
    day = day.select("book", F.col("_v.variant").alias("variant"), "gross", cost.alias("cost"))
    return day.groupBy("book", "variant").agg(F.sum(F.col("gross") - F.col("cost")).alias("total"), F.min(F.col("gross") - F.col("cost")).alias("worst"), F.sum("cost").alias("cost"))


def execution_arms(weights: DataFrame, panel: DataFrame, dates: DataFrame, bps: float, notional: float, gross: float = 2.0) -> DataFrame:
    """(book, arm, total, worst, cost): the books as they are, held from open to open, from open to close only, a date later, and in whole shares of a book of `notional`.

    panel: (date, ticker, open, close, ret). Weights are first scaled to the gross cap. Whole shares are rounded half to even at the close; without a price nothing is held, and what is held after rounding trades and earns.
    """
    size = F.sum(F.abs("w")).over(Window.partitionBy("book", "date"))
    capped = weights.withColumn("w", F.when(size > gross, F.col("w") * gross / size).otherwise(F.col("w")))
    grid = weights.select("book", "ticker").distinct().crossJoin(F.broadcast(dates.select("date")))  # a row per date
    x = grid.join(capped, ["book", "date", "ticker"], "left").join(panel.select("date", "ticker", "open", "close", "ret"), ["date", "ticker"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    t = by("book", "ticker")
    shares = F.coalesce(F.bround(ratio(F.col("w") * notional, F.col("close"))) * F.col("close") / notional, F.lit(0.0))
    x = x.withColumn("_s", shares).withColumn("_oo", ratio(F.lead("open").over(t), F.col("open")) - 1).withColumn("_oc", ratio(F.col("close"), F.col("open")) - 1)
    was = lambda c, n=1: F.coalesce(F.lag(c, n).over(t), F.lit(0.0))
    turn, share_turn = F.abs(F.col("w") - was("w")), F.abs(F.col("_s") - was("_s"))
    arms = {"close": (was("w"), "ret", turn), "open_to_open": (was("w"), "_oo", turn), "intraday": (was("w"), "_oc", turn), "late": (was("w", 2), "ret", turn), "whole_shares": (was("_s"), "ret", share_turn)}
    x = x.withColumns({f"_e_{k}": h * F.col(r) for k, (h, r, _) in arms.items()} | {f"_c_{k}": c * bps / 1e4 for k, (*_, c) in arms.items()})
    each = x.select("book", "date", F.explode(F.array(*[F.struct(F.lit(k).alias("arm"), F.col(f"_e_{k}").alias("e"), F.col(f"_c_{k}").alias("c")) for k in arms])).alias("v")).select("book", "date", "v.*")
    day = each.groupBy("book", "arm", "date").agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("e"), F.sum("c").alias("c")).withColumn("net", F.col("e") - F.col("c"))
    return day.groupBy("book", "arm").agg((F.exp(F.sum(F.log1p("net"))) - 1).alias("total"), F.min("net").alias("worst"), F.sum("c").alias("cost"))
