"""Books over a few market series: functions from the wide macro table (a row per date) to (date, ticker, w).

Windows here order one row per date. Weekly data: 40 rows for 200 days, 52 for a year, 13 for a quarter, 4 for a month.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from panelweave.functions.columns import clip, ratio, rolling_mean, rolling_median, rolling_std
from panelweave.operators import state as P
from panelweave.plans.books import register_book

YEAR = 52.0
REGIONS = tuple(f"r{i}" for i in range(5))


def days() -> WindowSpec:
    return Window.orderBy("date")


def past() -> WindowSpec:
    return days().rowsBetween(Window.unboundedPreceding, 0)


def legs(m: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """A row for each date and leg with a weight; null weighs nothing."""
    m = m.select("date", *[F.coalesce(w.cast("double"), F.lit(0.0)).alias(t) for t, w in weights.items()])
    return m.select("date", F.inline(F.array(*[F.struct(F.lit(t.upper()).alias("ticker"), F.col(t).alias("w")) for t in weights])))


def vol(ret: str, n: int) -> Column:
    return rolling_std(ret, n) * F.sqrt(F.lit(YEAR))


def mom(c: str, n: int) -> Column:
    return ratio(F.col(c), F.lag(c, n).over(days())) - 1


def held(up: Column, down: Column, first: Column | None = None) -> Column:
    """1 after up, 0 after down, held in between; before either: what `first` was when it was first known."""
    mark = F.last(F.when(up, 1).when(down, 0), ignorenulls=True).over(past())
    return mark if first is None else F.coalesce(mark, F.first(first.cast("int"), ignorenulls=True).over(past()))


def on_dates(w: Column, when: Column) -> Column:
    """The value of the last row on which `when` holds."""
    return F.last(F.when(when, w), ignorenulls=True).over(past())


def breadth_gated(m: DataFrame, n: int = 13, on: float = 2.0, target: float = 0.01) -> DataFrame:
    """Full leverage while region 0 gains on the market, else a volatility target; nothing before both are known."""
    q = F.col("r0") / F.col("mkt")
    m = m.withColumn("_b", q / F.lag(q, n).over(days()) - 1).withColumn("_v", vol("mkt_ret", n))
    off = clip(ratio(F.lit(target), F.col("_v")), None, on)
    return legs(m, {"mkt": F.when(F.col("_b").isNull() | F.col("_v").isNull(), 0.0).when(F.col("_b") > 0, on).otherwise(off)})


def trend_vol(m: DataFrame, n: int = 40, lookback: int = 13, target: float = 0.01, cap: float = 2.0, band: float = 0.01, width: float = 0.05) -> DataFrame:
    """A volatility target above the moving average (1 % band), cash below; weights move when either leg is off by more than the width."""
    above = F.col("mkt") / rolling_mean("mkt", n) - 1
    m = m.withColumn("_a", above)
    m = m.withColumn("gate", held(F.col("_a") > band, F.col("_a") < -band, F.col("_a") > 0)).withColumn("target", clip(ratio(F.lit(target), vol("mkt_ret", lookback)), None, cap))
    m = m.where("_a is not null").withColumn("want", F.when(F.col("gate") == 1, F.col("target"))).withColumn("key", F.lit("MKT"))

    def step(s: float, want: float | None) -> float:
        """The risky leg, -1 while in cash; 0 before anything was held."""
        to = -1.0 if want is None else want
        return to if max(abs(max(to, 0.0) - max(s, 0.0)), abs(float(to < 0) - float(s < 0))) > width else s

    out = P.fold(m, ["key"], ["want"], 0.0, step, "s", DoubleType())
    return legs(out, {"mkt": F.greatest("s", F.lit(0.0)), "cash": (F.col("s") < 0).cast("double")})


def panic_buyer(m: DataFrame, n: int = 13, spike: float = 1.1, release: float = 1.0, base: float = 1.5, more: float = 2.0) -> DataFrame:
    """More of the market from a spike of the volatility index over its median until it is released."""
    m = m.withColumn("_q", ratio(F.col("volx"), rolling_median("volx", n)))
    return legs(m, {"mkt": F.when(F.coalesce(held(F.col("_q") >= spike, F.col("_q") < release), F.lit(0)) == 1, more).otherwise(base)})


def short_vol_carry(m: DataFrame, ceiling: float = 1.2, mult: float = 0.9, weight: float = 0.5, n: int = 4) -> DataFrame:
    """Half the volatility seller (region 4), half the market while the index is low and above what was realised; else cash."""
    on = F.coalesce((F.col("volx") < ceiling) & (F.col("volx") > mult * 100 * vol("mkt_ret", n)), F.lit(False)).cast("double")
    m = m.withColumn("_on", on)
    return legs(m, {"r4": F.col("_on") * weight, "mkt": F.col("_on") * (1 - weight), "cash": 1 - F.col("_on")})


def vol_core(m: DataFrame, target: float = 0.01, n: int = 13, calm: int = 26, sleeve: float = 0.2, cap: float = 2.0, gross: float = 1.5) -> DataFrame:
    """Two volatility-managed legs and a sleeve while the index is below its median, scaled to the gross cap."""
    leg = lambda c, share: F.coalesce(share * clip(ratio(F.lit(target), vol(c, n)), None, cap), F.lit(0.0))
    m = m.withColumns({"_a": leg("r0_ret", 0.6), "_b": leg("mkt_ret", 0.4), "_c": F.when(F.col("volx") < rolling_median("volx", calm), sleeve).otherwise(0.0)})
    total = F.col("_a") + F.col("_b") + F.col("_c")
    scale = F.when(total > gross, gross / total).otherwise(1.0)
    return legs(m, {"r0": F.col("_a") * scale, "mkt": F.col("_b") * scale, "r4": F.col("_c") * scale})


def term_gate(m: DataFrame, slow: int = 26) -> DataFrame:
    """(date, ticker, w, bench): the volatility seller while the index is below its slow form, else cash, a day late; bench: the same mean exposure held throughout."""
    on = (F.col("volx") < 100 * vol("mkt_ret", slow)).cast("double")
    m = m.withColumn("_s", on).withColumn("_s", F.coalesce(F.lag("_s").over(days()), F.lit(0.0)))
    out = legs(m, {"r4": F.col("_s"), "cash": 1 - F.col("_s")})
    return out.withColumn("bench", F.avg("w").over(Window.partitionBy("ticker")))


def dual(m: DataFrame, risky: tuple[str, ...], safe: tuple[str, ...], n: int = 52, leverage: float = 1.5, skip: int = 0) -> DataFrame:
    """At confirmed month ends the best of the risky menu with leverage if it beats cash, else the best of the safe one; held until the next. One ticker a date."""
    menu = dict.fromkeys((*risky, *safe, "cash"))
    m = m.withColumns({f"_m_{c}": F.round(ratio(F.lag(c, skip).over(days()) if skip else F.col(c), F.lag(c, n).over(days())) - 1, 9) for c in menu})

    def best(names: tuple[str, ...]) -> Column:
        top = F.greatest(*[F.col(f"_m_{c}") for c in names]) if len(names) > 1 else F.col(f"_m_{names[0]}")
        return F.coalesce(*[F.when(F.col(f"_m_{c}") == top, F.lit(c.upper())) for c in names])

    known = F.lit(True)
    for c in menu:
        known = known & F.col(f"_m_{c}").isNotNull()
    top = F.greatest(*[F.col(f"_m_{c}") for c in risky])
    pick = F.when(~known, F.struct(F.lit("NONE").alias("ticker"), F.lit(0.0).alias("w"))).when(top > F.col("_m_cash"), F.struct(best(risky).alias("ticker"), F.lit(leverage).alias("w"))).otherwise(F.struct(best(safe).alias("ticker"), F.lit(1.0).alias("w")))
    m = m.withColumn("_pick", on_dates(pick, F.col("month_end_confirmed")))
    return m.where("_pick.w > 0").select("date", "_pick.*")


def dual_momentum(m: DataFrame) -> DataFrame:
    return dual(m, ("r0", "r1", "r2"), ("r3",))


def dual_momentum_gold(m: DataFrame) -> DataFrame:
    return dual(m, ("r0", "r1", "r4"), ("r3", "cash"))


def dual_momentum_swapped(m: DataFrame, thirds: dict[str, tuple[str, ...]]) -> DataFrame:
    """(third, date, ticker, w): the gold rule with other assets, or none, in the place of its third one."""
    return reduce(DataFrame.unionByName, [dual(m, ("r0", "r1", *third), ("r3", "cash")).withColumn("third", F.lit(name)) for name, third in thirds.items()])


def _inverse_vol_signs(m: DataFrame, n: int, look: int, floor: float) -> dict[str, Column]:
    """Sign of momentum times inverse volatility over the regions, gross one; null unless all are known."""
    inverse = {c: 1 / F.greatest(vol(f"{c}_ret", look), F.lit(floor)) for c in REGIONS}
    total = sum(inverse.values(), F.lit(0.0))
    known = F.lit(True)
    for c in REGIONS:
        known = known & rolling_std(f"{c}_ret", look).isNotNull() & mom(c, n).isNotNull()
    return {c: F.when(known, F.signum(mom(c, n)) * inverse[c] / total) for c in REGIONS}


def trend_multi(m: DataFrame, n: int = 26, look: int = 13, floor: float = 1e-6, target: float = 0.005, cap: float = 2.0) -> DataFrame:
    """At the first date of a month: trends scaled so that these weights, held over the trailing window, had the target volatility; held until the next."""
    m = m.withColumns({f"_w_{c}": w for c, w in _inverse_vol_signs(m, n, look, floor).items()})

    def fixed(c: str) -> Column:
        w = F.col(f"_w_{c}")
        return F.transform(F.collect_list(f"{c}_ret").over(days().rowsBetween(-(look - 1), 0)), lambda x: x * w)

    book = fixed(REGIONS[0])
    for c in REGIONS[1:]:
        book = F.zip_with(book, fixed(c), lambda a, b: a + b)
    m = m.withColumn("_book", book)
    size = F.size("_book")
    m = m.withColumn("_mean", ratio(F.aggregate("_book", F.lit(0.0), lambda s, x: s + x), size))
    squares = F.aggregate("_book", F.lit(0.0), lambda s, x: s + (x - F.col("_mean")) * (x - F.col("_mean")))
    m = m.withColumn("_sd", F.sqrt(ratio(squares, size - 1)) * F.sqrt(F.lit(YEAR)))
    scale = F.coalesce(clip(ratio(F.lit(target), F.col("_sd")), None, cap), F.lit(0.0))
    when = F.col("month_first") & (F.col("pos") > 1)
    return legs(m, {c: on_dates(F.coalesce(F.col(f"_w_{c}") * scale, F.lit(0.0)), when) for c in REGIONS})


def defensive_ensemble(m: DataFrame, n: int = 52, look: int = 13, target: float = 0.01, sleeve_target: float = 0.01, gross: float = 2.0) -> DataFrame:
    """Three sleeves (gated market, monthly trends, monthly dual momentum) weighted by inverse volatility, scaled to a volatility target under a gross cap."""
    names = ("mkt", "cash", *REGIONS)
    above = F.col("mkt") / rolling_mean("mkt", 40) - 1
    m = m.withColumn("_above", above).withColumn("_g", F.coalesce(held(F.col("_above") > 0.01, F.col("_above") < -0.01), F.lit(0)))
    a = {"mkt": F.coalesce(F.col("_g") * clip(ratio(F.lit(sleeve_target), vol("mkt_ret", look)), None, 2.0), F.lit(0.0)), "cash": 1.0 - F.col("_g")}
    b = {c: F.coalesce(on_dates(F.coalesce(w, F.lit(0.0)), F.col("month_first")), F.lit(0.0)) for c, w in _inverse_vol_signs(m, n, look, 1e-6).items()}
    m = m.withColumns({f"_a_{c}": a.get(c, F.lit(0.0)) for c in names} | {f"_b_{c}": b.get(c, F.lit(0.0)) for c in names})
    risky, safe = ("mkt", "r0", "r4"), ("r3", "cash")
    m = m.withColumns({f"_m_{c}": F.round(mom(c, n), 9) for c in (*risky, *safe)})
    top, low = F.greatest(*[F.col(f"_m_{c}") for c in risky]), F.greatest(*[F.col(f"_m_{c}") for c in safe])
    known = F.lit(True)
    for c in (*risky, *safe):
        known = known & F.col(f"_m_{c}").isNotNull()
    first = lambda menu, best: F.coalesce(*[F.when(F.col(f"_m_{c}") == best, F.lit(c)) for c in menu])
    m = m.withColumn("_pick", on_dates(F.when(~known, "none").when(top > F.col("_m_cash"), first(risky, top)).otherwise(first(safe, low)), F.col("month_first")))
    m = m.withColumns({f"_c_{c}": F.coalesce((F.col("_pick") == c).cast("double"), F.lit(0.0)) for c in names})
    earned = lambda k: sum((F.coalesce(F.lag(f"_{k}_{c}").over(days()) * F.col(f"{c}_ret"), F.lit(0.0)) for c in names), F.lit(0.0))
    m = m.withColumns({f"_ret_{k}": F.when(F.col("pos") > 1, earned(k)) for k in "abc"})
    m = m.withColumns({f"_inv_{k}": ratio(F.lit(1.0), F.round(rolling_std(f"_ret_{k}", look), 12)) for k in "abc"})
    total = sum((F.coalesce(F.col(f"_inv_{k}"), F.lit(0.0)) for k in "abc"), F.lit(0.0))
    m = m.withColumns({f"_sw_{k}": F.coalesce(on_dates(F.when(total > 0, F.coalesce(F.col(f"_inv_{k}"), F.lit(0.0)) / total), F.col("month_first")), F.lit(1.0 / 3)) for k in "abc"})
    m = m.withColumns({f"_w_{c}": sum((F.col(f"_{k}_{c}") * F.col(f"_sw_{k}") for k in "abc"), F.lit(0.0)) for c in names})
    m = m.withColumn("_book", F.when(F.col("pos") > 1, earned("w")))
    size = sum((F.abs(f"_w_{c}") for c in names), F.lit(0.0))
    lev = F.least(ratio(F.lit(target), F.round(vol("_book", look), 12)), ratio(F.lit(gross), size))
    m = m.withColumn("_lev", F.when(rolling_std("_book", look).isNotNull() & (F.round(vol("_book", look), 12) > 0), lev).otherwise(1.0))
    return legs(m, {c: F.col(f"_w_{c}") * F.col("_lev") for c in names})


MACRO_BOOKS = {
    "breadth_gated": breadth_gated, "trend_vol": trend_vol, "panic_buyer": panic_buyer, "short_vol_carry": short_vol_carry, "vol_core": vol_core, "term_gate": term_gate,
    "dual_momentum_hold": dual_momentum, "dual_momentum_gold": dual_momentum_gold, "tsmom_scaled": trend_multi, "defensive_ensemble": defensive_ensemble,
}
for _name, _build in MACRO_BOOKS.items():
    register_book(_name, _build)
