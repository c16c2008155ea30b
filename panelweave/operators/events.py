"""Event studies and the point-in-time macro layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, corr_from_sums, ratio
from panelweave.operators.cross_section import quantile_bucket


def surprise(events: DataFrame, floor: float = 0.01) -> DataFrame:
    return events.withColumn("surprise", (F.col("actual") - F.col("estimate")) / F.greatest(F.abs("estimate"), F.lit(floor)))


def trailing_sue(events: DataFrame, n: int = 4, least: int = 2) -> DataFrame:
    """sue: actual less estimate over the deviation of up to n earlier surprises, or over |estimate| with fewer than `least` of them."""
    e = events.where("actual is not null and estimate is not null").withColumn("_d", F.col("actual") - F.col("estimate"))
    w = by("symbol", order="period").rowsBetween(-n, -1)
    scale = F.when(F.count("_d").over(w) >= least, F.stddev_samp("_d").over(w)).otherwise(F.abs("estimate"))
    return e.withColumn("sue", ratio(F.col("_d"), scale)).drop("_d")


def reaction_session(events: DataFrame, calendar: DataFrame) -> DataFrame:
    """The first date of the calendar on or after the report ('bmo') or the day after it."""
    e = events.withColumn("_from", F.when(F.col("hour") == "bmo", F.col("report_date")).otherwise(F.date_add("report_date", 1)))
    ahead = calendar.select(F.col("date").alias("_from"), F.col("date").alias("session")).unionByName(e.select("_from", F.lit(None).cast("date").alias("session")))
    ahead = ahead.where("_from is not null").groupBy("_from").agg(F.max("session").alias("session"))  # one row per date
    ahead = ahead.select("_from", F.min("session").over(Window.orderBy("_from").rowsBetween(0, Window.unboundedFollowing)).alias("session"))
    return e.join(ahead, "_from", "left").drop("_from")


def car(events: DataFrame, panel: DataFrame, low: int, high: int) -> DataFrame:
    """Cumulative abnormal return (ret - m) around each event's session position; missing returns add nothing, unknown names give null."""
    days = panel.select("date").distinct().withColumn("pos", F.row_number().over(Window.orderBy("date")))  # one row per date
    pos = panel.select("ticker", "date", (F.col("ret") - F.col("m")).alias("ar")).join(days, "date")
    located = events.join(days.select(F.col("date").alias("session"), F.col("pos").alias("at")), "session").select(F.col("symbol").alias("ticker"), "period", "at")
    known = pos.select("ticker").distinct().withColumn("_known", F.lit(True))
    x = located.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("k")).withColumn("pos", F.col("at") + F.col("k"))
    x = x.join(pos.select("ticker", "pos", "ar"), ["ticker", "pos"], "left").join(known, "ticker", "left")
    w = Window.partitionBy("ticker", "period").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("ticker", "period", "k", F.when(F.col("_known"), F.sum(F.coalesce("ar", F.lit(0.0))).over(w)).alias("car"))


def drift_spread(cars: DataFrame, scores: DataFrame, q: int) -> DataFrame:
    """Mean car of the highest less the lowest score bucket for each k; buckets over all events."""
    b = quantile_bucket(scores.select(F.lit(0).alias("date"), F.concat_ws("|", "symbol", "period").alias("ticker"), "sue"), q, "sue").select(F.col("ticker").alias("key"), "bucket")
    x = cars.withColumn("key", F.concat_ws("|", "ticker", "period")).join(b, "key")
    top, low = F.avg(F.when(F.col("bucket") == q - 1, F.col("car"))), F.avg(F.when(F.col("bucket") == 0, F.col("car")))
    return x.groupBy("k").agg(top.alias("top"), low.alias("low"), (top - low).alias("spread"))


def ic_decay(cars: DataFrame, scores: DataFrame, horizons: list[int]) -> DataFrame:
    x = cars.where(F.col("k").isin(horizons)).join(scores.select(F.col("symbol").alias("ticker"), "period", "sue"), ["ticker", "period"]).where("sue is not null and car is not null")
    hit = F.avg((F.signum("sue") == F.signum("car")).cast("double"))
    return x.groupBy("k").agg(F.count("*").alias("n"), corr_from_sums(F.col("sue"), F.col("car")).alias("ic"), hit.alias("hit"))


def business_day_shift(c: str | Column, k: int) -> Column:
    """The date k business days on (k < 5 here is all that lags need); a weekend date counts from the Friday before."""
    d = F.col(c) if isinstance(c, str) else c
    dow = F.weekday(d)
    base = F.date_sub(d, F.greatest(dow - 4, F.lit(0)))
    at = F.weekday(base) + k
    return F.date_add(base, (k + 2 * F.floor(at / 5)).cast("int"))


def available(series: DataFrame, lags: dict[str, int], default: int = 0) -> DataFrame:
    """(series, avail_date, value): observation dates moved by the series' lag; of those that fall on one date the last observation."""
    lag = F.coalesce(F.create_map(*[x for k, v in lags.items() for x in (F.lit(k), F.lit(v))])[F.col("series")], F.lit(default))
    shifted = F.coalesce(*[F.when(lag == k, business_day_shift("obs_date", k)) for k in sorted({default, *lags.values()})])
    return series.groupBy("series", shifted.alias("avail_date")).agg(F.max_by("value", "obs_date").alias("value"), F.max("obs_date").alias("obs_date"))


def state_features(wide: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    return wide.select("*", *[(F.col(a) - F.col(b)).alias(f"{a}_less_{b}") for a, b in pairs], *[ratio(F.col(a), F.col(b)).alias(f"{a}_over_{b}") for a, b in pairs])


def provenance(vintages: DataFrame) -> DataFrame:
    """Per observation: first and latest vintage's value, days until the first, number of vintages, whether it was revised."""
    g = vintages.groupBy("series", "obs_date").agg(F.min_by("value", "realtime_start").alias("first"), F.max_by("value", "realtime_start").alias("latest"), F.min("realtime_start").alias("_f"), F.count_distinct("realtime_start").alias("vintages"))
    return g.select("series", "obs_date", "first", "latest", F.datediff("_f", "obs_date").alias("lag_days"), "vintages", (F.col("first") != F.col("latest")).alias("revised"))


def manifest(series: DataFrame, days: int) -> DataFrame:
    """Per series: first and last observation, number, and the missing share of the days of the span."""
    g = series.groupBy("series").agg(F.min("obs_date").alias("first"), F.max("obs_date").alias("last"), F.count("value").alias("n"))
    return g.withColumn("missing", 1 - F.col("n") / F.lit(float(days)))


def truncation_audit(full: DataFrame, cut: DataFrame, keys: list[str], value: str, tolerance: float = 1e-9) -> DataFrame:
    """A value computed from a truncated input must equal that from the full one wherever both exist: cells, leaks and a verdict."""
    both = cut.select(*keys, F.col(value).alias("x")).join(full.select(*keys, F.col(value).alias("y")), keys, "left")
    leak = F.coalesce(F.abs(F.col("x") - F.col("y")) > tolerance, F.col("x").isNull() != F.col("y").isNull())
    return both.agg(F.count("*").alias("cells"), F.count_if(leak).alias("leaks")).withColumn("verdict", F.when(F.col("leaks") == 0, "PASS").otherwise("BLOCK"))


def panel_quality(panel: DataFrame) -> DataFrame:
    """Per ticker: cells, missing cells inside its life, members without a price, unchanged closes in a row, nonpositive prices."""
    w = by("ticker")
    p = panel.withColumn("_first", F.min(F.when(F.col("close").isNotNull(), F.col("date"))).over(Window.partitionBy("ticker"))).withColumn("_last", F.max(F.when(F.col("close").isNotNull(), F.col("date"))).over(Window.partitionBy("ticker")))
    p = p.withColumn("_same", F.col("close") == F.lag("close").over(w))
    return p.groupBy("ticker").agg(
        F.count("*").alias("cells"), F.count_if(F.col("close").isNull() & F.col("date").between(F.col("_first"), F.col("_last"))).alias("holes"), F.count_if(F.col("member") & F.col("close").isNull()).alias("member_unpriced"), F.count_if("_same").alias("flat"), F.count_if(F.col("close") <= 0).alias("nonpositive"),
        F.first("_first").alias("first"), F.first("_last").alias("last"),
    )


def ic_report(cars: DataFrame, scores: DataFrame, horizons: list[int], least: int) -> DataFrame:
    """(k, n, ic, t, verdict): Pearson correlation of score and cumulative return per horizon; few events still accumulate."""
    g = ic_decay(cars, scores, horizons).drop("hit")
    t = ratio(F.col("ic") * F.sqrt((F.col("n") - 2).cast("double")), F.sqrt(1 - F.col("ic") * F.col("ic")))
    g = g.withColumn("t", F.when(F.col("n") >= 3, t))
    return g.withColumn("verdict", F.when(F.col("n") < least, "ACCUMULATING").when(F.col("t") > 2, "PASS").when(F.col("t") < 0, "KILL").otherwise("INDETERMINATE"))


def checkpoint(events: DataFrame, cars: DataFrame, k: int, least: int, top: float, missing: float, names: int = 5) -> DataFrame:
    """One row of six arming conditions and whether all hold: matured events, share of missing estimates, largest name's share, keys that are null or double, names, and
    matured events that have an estimate."""
    total = events.agg(F.count("*").alias("events"), F.avg(F.col("estimate").isNull().cast("double")).alias("missing"), F.count_distinct("symbol").alias("names"), F.count_if(F.col("symbol").isNull() | F.col("period").isNull()).alias("_null"))
    largest = events.groupBy("symbol").agg(F.count("*").alias("_n")).agg((F.max("_n") / F.sum("_n")).alias("largest"))
    double = events.groupBy("symbol", "period").agg((F.count("*") - 1).alias("_d")).agg(F.sum("_d").alias("_double"))
    ripe = cars.where((F.col("k") == k) & F.col("car").isNotNull()).join(events.select(F.col("symbol").alias("ticker"), "period", "estimate"), ["ticker", "period"], "left")
    ripe = ripe.agg(F.count("*").alias("matured"), F.avg(F.col("estimate").isNotNull().cast("double")).alias("usable"))
    out = total.crossJoin(F.broadcast(largest)).crossJoin(F.broadcast(double)).crossJoin(F.broadcast(ripe))  # one row each
    out = out.withColumn("bad_keys", F.col("_null") + F.coalesce("_double", F.lit(0))).drop("_null", "_double")
    armed = (F.col("matured") >= least) & (F.col("missing") <= missing) & (F.col("largest") <= top) & (F.col("bad_keys") == 0) & (F.col("names") >= names) & (F.col("usable") >= 1 - missing)
    return out.withColumn("armed", F.coalesce(armed, F.lit(False)))


def leakage_audits(series: DataFrame, lags: dict[str, int], today: Column, stale: int, alike: float) -> DataFrame:
    """(audit, cells, leaks, verdict) of the point-in-time layer: availability (no value before its lag), calendar (no value on a weekend), poison (a value that is known before `today` doesn't
    change when all later observations do), staleness (gaps beyond `stale` days) and cross_source (pairs of series whose changes correlate beyond `alike`)."""
    known = available(series, lags)
    shift = F.coalesce(F.create_map(*[x for k, v in lags.items() for x in (F.lit(k), F.lit(v))])[F.col("series")], F.lit(0))
    gap = F.datediff("obs_date", F.lag("obs_date").over(by("series", order="obs_date")))
    poisoned = available(series.withColumn("value", F.when(F.col("obs_date") >= today, F.lit(-1e9)).otherwise(F.col("value"))), lags).select("series", "avail_date", F.col("value").alias("_p"))
    both = known.where(F.col("avail_date") < today).join(poisoned, ["series", "avail_date"], "left")
    change = series.withColumn("_c", F.col("value") - F.lag("value").over(by("series", order="obs_date")))
    pairs = change.select("obs_date", F.col("series").alias("a"), F.col("_c").alias("x")).join(change.select("obs_date", F.col("series").alias("b"), F.col("_c").alias("y")), "obs_date").where("a < b")
    pairs = pairs.groupBy("a", "b").agg(corr_from_sums(F.col("x"), F.col("y")).alias("c"))
    rows = [
        ("availability", known, F.datediff("avail_date", "obs_date") < shift), ("calendar", known, F.weekday("avail_date") > 4), ("poison", both, ~F.col("value").eqNullSafe(F.col("_p"))),
        ("staleness", series.withColumn("_gap", gap), F.coalesce(F.col("_gap") > stale, F.lit(False))), ("cross_source", pairs, F.coalesce(F.abs("c") > alike, F.lit(False))),
    ]
    out = [x.agg(F.lit(name).alias("audit"), F.count("*").alias("cells"), F.count_if(leak).alias("leaks")) for name, x, leak in rows]
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole.withColumn("verdict", F.when(F.col("leaks") == 0, "PASS").otherwise("BLOCK"))


def panel_gaps(panel: DataFrame, step: int = 7, few: float = 0.5) -> DataFrame:
    """(kind, ticker, date): calendar gaps (a date more than `step` days after the one before), phantom dates (fewer than a share of the usual number of names priced) and early ends (a
    name's last price before the panel's last date)."""
    days = panel.groupBy("date").agg(F.count("close").alias("_n"))
    usual = days.agg(F.percentile("_n", F.lit(0.5)).alias("_usual"), F.max("date").alias("_end"))
    days = days.withColumn("_gap", F.datediff("date", F.lag("date").over(Window.orderBy("date")))).crossJoin(F.broadcast(usual))  # one row per date, and one of all
    none = F.lit(None).cast("string").alias("ticker")
    last = panel.where("close is not null").groupBy("ticker").agg(F.max("date").alias("date")).crossJoin(F.broadcast(usual))
    gaps = days.where(F.col("_gap") > step).select(F.lit("gap").alias("kind"), none, "date")
    phantoms = days.where(F.col("_n") < few * F.col("_usual")).select(F.lit("phantom").alias("kind"), none, "date")
    return gaps.unionByName(phantoms).unionByName(last.where("date < _end").select(F.lit("early_end").alias("kind"), "ticker", "date"))


def bond_carry(wide: DataFrame, buckets: dict[str, tuple[str, str, str, float]]) -> DataFrame:
    """(date, bucket, carry, z): a bucket's yield less funding plus its slope to the next shorter yield over the years between, and its distance from the date's buckets. buckets: name:
    (yield, funding, shorter yield, years)."""
    each = F.array(*[F.struct(F.lit(k).alias("bucket"), ((F.col(y) - F.col(f)) + (F.col(y) - F.col(s)) / years).alias("carry")) for k, (y, f, s, years) in buckets.items()])
    x = wide.select("date", F.explode(each).alias("b")).select("date", "b.*").where("carry is not null")
    w = Window.partitionBy("date")
    return x.withColumn("z", ratio(F.col("carry") - F.avg("carry").over(w), F.stddev_pop("carry").over(w)))
