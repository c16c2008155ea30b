"""Bars, returns and calendars on a long (date, ticker) panel."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, rolling_mean, rolling_median


def calendar(bars: DataFrame) -> DataFrame:
    """Dates with a price: pos (from 1), month, first and last of month, month_end_confirmed (a later month has begun)."""
    days = bars.where("close is not null").select("date").distinct()
    w = Window.orderBy("date")
    days = days.withColumn("pos", F.row_number().over(w).cast("long")).withColumn("month", F.to_date(F.date_trunc("month", "date")))
    before, after = F.lag("month").over(w), F.lead("month").over(w)
    return days.withColumns({"month_first": F.coalesce(before != F.col("month"), F.lit(True)), "month_last": F.coalesce(after != F.col("month"), F.lit(True)), "month_end_confirmed": F.coalesce(after != F.col("month"), F.lit(False))})


def densify(bars: DataFrame, dates: DataFrame) -> DataFrame:
    """Every date for every ticker; missing cells are null. The calendar is the smaller side of the product."""
    grid = bars.select("ticker").distinct().crossJoin(dates)
    return grid.join(bars, ["date", "ticker"], "left")


def daily_returns(panel: DataFrame, pad: bool = False, price: str = "close") -> DataFrame:
    """panel with ret: simple return to the previous date; pad carries the last price over gaps."""
    held = F.last(price, ignorenulls=True).over(by("ticker").rowsBetween(Window.unboundedPreceding, 0)) if pad else F.col(price)
    return panel.withColumn("_p", held).withColumn("ret", F.col("_p") / F.lag("_p").over(by("ticker")) - 1).drop("_p")


def normalize(panel: DataFrame, price: str = "close") -> DataFrame:
    first = F.first(price, ignorenulls=True).over(by("ticker").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return panel.withColumn("norm", F.col(price) / first)


def overnight_intraday(panel: DataFrame) -> DataFrame:
    return panel.withColumn("overnight", F.col("open") / F.lag("close").over(by("ticker")) - 1).withColumn("intraday", F.col("close") / F.col("open") - 1)


def dollar_adv(panel: DataFrame, n: int = 20) -> DataFrame:
    return panel.withColumn("_v", F.col("close") * F.col("volume")).withColumn("adv", rolling_median("_v", n, "ticker")).drop("_v")


def volume_ratio(panel: DataFrame, n: int = 20) -> DataFrame:
    return panel.withColumn("volume_ratio", F.try_divide(F.col("volume"), rolling_mean("volume", n, "ticker")))


def resample(panel: DataFrame, unit: str = "month") -> DataFrame:
    """Per ticker and period: last close, sum of volume, compounded return, dates with a price. Missing returns count as zero."""
    period = F.to_date(F.date_trunc(unit, "date"))
    return panel.groupBy("ticker", period.alias("period")).agg(
        F.max_by("close", F.when(F.col("close").isNotNull(), F.col("date"))).alias("close"), F.sum("volume").alias("volume"), (F.exp(F.sum(F.log1p(F.coalesce("ret", F.lit(0.0))))) - 1).alias("ret"), F.count("close").alias("n")
    )


def hold_until(rows: DataFrame, dates: DataFrame) -> DataFrame:
    """(date, ticker, w) given on rebalance dates, held on every date until the next one; a ticker that is not named again leaves."""
    marks = rows.select("date").distinct()
    spans = marks.select(F.col("date").alias("start"), F.lead("date").over(Window.orderBy("date")).alias("stop"))
    each = dates.join(spans, (F.col("date") >= F.col("start")) & (F.col("stop").isNull() | (F.col("date") < F.col("stop")))).select("date", "start")
    return each.join(rows.withColumnRenamed("date", "start"), "start").select("date", "ticker", "w")


def extend(panel: DataFrame, more: DataFrame) -> DataFrame:
    """The union of two panels; where both have a cell, the first one's values count, and its gaps are filled from the second."""
    keys, fields = ["date", "ticker"], [c for c in panel.columns if c not in ("date", "ticker")]
    b = more.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields])
    out = panel.join(b, keys, "full").select(*keys, *[F.coalesce(c, f"_{c}").alias(c) for c in fields])
    live = out.groupBy("date").agg(F.count("close").alias("_n")).where("_n > 0").select("date")
    return out.join(live, "date", "left_semi")


def heal(panel: DataFrame, tickers: list[str]) -> DataFrame:
    """close carried forward for the chosen tickers only."""
    last = F.last("close", ignorenulls=True).over(by("ticker").rowsBetween(Window.unboundedPreceding, 0))
    return panel.withColumn("close", F.when(F.col("ticker").isin(tickers), last).otherwise(F.col("close")))


def split_by_cut(panel: DataFrame, cut: str) -> DataFrame:
    return panel.withColumn("part", F.when(F.col("date") <= F.lit(cut).cast("date"), "train").otherwise("holdout"))


def log_returns(panel: DataFrame) -> DataFrame:
    return panel.withColumn("log_ret", F.ln("close") - F.lag(F.ln("close")).over(by("ticker")))
