"""Validation, point-in-time universes, filters and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import clip


def validate_panel(panel: DataFrame, keys: tuple[str, ...] = ("date", "ticker")) -> DataFrame:
    """One row: n_rows, n_duplicate_keys, n_null_keys and ok."""
    counts = panel.groupBy(*keys).agg(F.count("*").alias("n"))
    null = F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) if len(keys) > 1 else F.col(keys[0]).isNull().cast("int")
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_duplicate_keys"), F.coalesce(F.sum(null * F.col("n")), F.lit(0)).alias("n_null_keys"))
    return out.withColumn("ok", (F.col("n_rows") > 0) & (F.col("n_duplicate_keys") == 0) & (F.col("n_null_keys") == 0))


def validate_signals(signals: DataFrame, name: str = "signalname") -> DataFrame:
    """(signalname, date, ret) without null returns; a missing column raises."""
    missing = {name, "date", "ret"} - set(signals.columns)
    if missing:
        raise ValueError(f"missing columns {sorted(missing)}")
    return signals.select(F.col(name).alias("signalname"), "date", "ret").dropna(subset=["ret"])


def long_short(signals: DataFrame, start: str) -> DataFrame:
    """Long-short returns from `start` on, percent to decimal."""
    return signals.where((F.col("port") == "LS") & (F.col("date") >= F.lit(start).cast("date"))).select("signalname", "date", (F.col("ret") / 100).alias("ret"))


def clean_ticker(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.replace(F.replace(F.upper(F.trim(c)), F.lit("."), F.lit("-")), F.lit("$"), F.lit(""))


def intervals(changes: DataFrame) -> DataFrame:
    """Snapshots as validity intervals: start <= date < stop; of snapshots of one date the last by arrival stands."""
    if "arrival" in changes.columns:
        last = Window.partitionBy("date").orderBy(F.desc("arrival"))
        changes = changes.withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return changes.select(F.col("date").alias("start"), F.lead("date").over(Window.orderBy("date")).alias("stop"), "members")


def membership_mask(changes: DataFrame, grid: DataFrame) -> DataFrame:
    """grid with member: whether the ticker is in the latest snapshot on or before the date; false before the first."""
    spans = intervals(changes)
    dates = grid.select("date").distinct()
    inside = (F.col("date") >= F.col("start")) & (F.col("stop").isNull() | (F.col("date") < F.col("stop")))
    members = dates.join(spans, inside).select("date", F.explode("members").alias("ticker"), F.lit(True).alias("member"))
    return grid.join(members, ["date", "ticker"], "left").withColumn("member", F.coalesce("member", F.lit(False)))


def ever_members(changes: DataFrame) -> DataFrame:
    return changes.select(F.explode("members").alias("ticker")).distinct()


def missing_members(changes: DataFrame, panel: DataFrame, since: str | None = None) -> DataFrame:
    recent = changes if since is None else changes.where(F.col("date") >= F.lit(since).cast("date"))
    return ever_members(recent).join(panel.select("ticker").distinct(), "ticker", "left_anti")


def coverage(panel: DataFrame) -> DataFrame:
    """Per ticker: member_days, priced_days and their ratio."""
    out = panel.groupBy("ticker").agg(F.count_if("member").alias("member_days"), F.count_if(F.col("member") & F.col("close").isNotNull()).alias("priced_days"))
    return out.withColumn("ratio", F.try_divide(F.col("priced_days").cast("double"), F.col("member_days").cast("double")))


def rename_candidates(symbols: DataFrame, reference: DataFrame) -> DataFrame:
    """Each unknown symbol's first known variant: itself, without its last character, with a share class, with dots as dashes."""
    s = F.col("ticker")
    variants = F.array(s, F.substring(s, 1, 2), F.concat(s, F.lit("Q")), F.replace(s, F.lit("-"), F.lit(".")), F.concat(F.lit("N"), F.substring(s, 2, 9)))
    tried = symbols.select("ticker", F.posexplode(variants).alias("priority", "variant"))
    known = tried.join(reference.select(F.col("ticker").alias("variant")).distinct(), "variant")
    return symbols.join(known.groupBy("ticker").agg(F.min_by("variant", "priority").alias("match"), F.min("priority").alias("priority")), "ticker", "left").withColumn(
        "event", F.when(F.col("match").isNull(), "unresolved").when(F.col("priority") == 0, "same").otherwise("renamed")
    )


def liquidity_filter(positions: DataFrame, floor: float) -> DataFrame:
    """position set to zero where adv is below the floor (a missing adv keeps it); removed marks where that changed something."""
    thin = F.coalesce(F.col("adv") < floor, F.lit(False))
    return positions.withColumn("removed", thin & (F.col("position") != 0)).withColumn("position", F.when(thin, 0).otherwise(F.col("position")))


def event_window(calendar: DataFrame, events: DataFrame, before: int, after: int) -> DataFrame:
    """(date, ticker) rows within [first session on or after the event - before, + after], by position."""
    located = events.join(calendar.select("date", "pos"), F.col("date") >= F.col("event_date")).groupBy("ticker", "event_date").agg(F.min("pos").alias("at"))
    around = located.select("ticker", F.explode(F.sequence(F.col("at") - before, F.col("at") + after)).alias("pos"))
    return around.join(calendar.select("date", "pos"), "pos").select("date", "ticker").distinct()


def calendar_blackout(dates: DataFrame, events: DataFrame, days: int) -> DataFrame:
    """(date, ticker) with an event within so many calendar days either way."""
    near = F.col("date").between(F.date_sub("event_date", days), F.date_add("event_date", days))
    return dates.join(events, near).select("date", "ticker").distinct()


def pit_zero(positions: DataFrame) -> DataFrame:
    return positions.withColumn("position", F.when(F.col("member"), F.col("position")).otherwise(0))


def clip_returns(returns: DataFrame, low: float, high: float) -> DataFrame:
    return returns.withColumn("ret", clip(F.col("ret"), low, high))


def min_cross_section(scores: DataFrame, least: int, score: str = "score") -> DataFrame:
    return scores.withColumn("_n", F.count(score).over(Window.partitionBy("date"))).where(F.col("_n") >= least).drop("_n")


def integrity(panel: DataFrame, share: float = 0.9) -> DataFrame:
    """Dates on which fewer than the share of members have a price."""
    out = panel.where("member").groupBy("date").agg(F.count("*").alias("expected"), F.count("close").alias("priced"))
    return out.withColumn("ok", F.col("priced") >= share * F.col("expected"))


def signal_only_violations(weights: DataFrame, signal_only: list[str]) -> DataFrame:
    return weights.where(F.col("ticker").isin(signal_only) & (F.col("w") != 0))
