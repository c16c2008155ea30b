"""Ledgers, orders and reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.functions.columns import by, ratio


def last_by_key(rows: DataFrame, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """Of rows with one key the last to arrive."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(arrival)))).where("_n = 1").drop("_n")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """new's rows, and those of old whose key new doesn't have."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def append_new(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """old as it is, and those of new that lie after old's last `order` for the key."""
    last = old.groupBy(*keys).agg(F.max(order).alias("_last"))
    return old.unionByName(new.join(last, keys, "left").where(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_last"))


def exchange_session(orders: DataFrame, stamp: str = "submitted_at", zone: str = "America/New_York", opens: str = "09:30") -> DataFrame:
    """Local session date of a UTC stamp, and whether it came before the open."""
    local = F.from_utc_timestamp(F.col(stamp).cast("timestamp"), zone)
    return orders.withColumn("local_date", F.to_date(local)).withColumn("pre_open", F.date_format(local, "HH:mm") < opens)


def slippage(fills: DataFrame) -> DataFrame:
    """Side-signed basis points of the fill price against close; positive costs."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    return fills.where("filled_qty > 0").withColumn("slip_bps", sign * (F.col("price") / F.col("close") - 1) * 1e4)


def slippage_summary(fills: DataFrame) -> DataFrame:
    s = slippage(fills).withColumn("notional", F.col("filled_qty") * F.col("price"))
    return s.groupBy("ticker", "side").agg(F.count("*").alias("fills"), F.avg("slip_bps").alias("mean_bps"), ratio(F.sum(F.col("slip_bps") * F.col("notional")), F.sum("notional")).alias("weighted_bps"))


def reconcile(fills: DataFrame) -> DataFrame:
    """Per session: orders, fills, partials, rejects, fill rate, mean slippage and the alarms that they set."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    g = fills.groupBy("session").agg(
        F.count("*").alias("orders"), F.count_if(F.col("status") == "filled").alias("filled"), F.count_if(F.col("status") == "partially_filled").alias("partial"), F.count_if(F.col("status") == "rejected").alias("rejected"),
        ratio(F.sum("filled_qty"), F.sum("qty")).alias("fill_rate"), F.avg(F.when(F.col("filled_qty") > 0, sign * (F.col("price") / F.col("close") - 1) * 1e4)).alias("slip_bps"),
    )
    alarms = F.array_compact(F.array(F.when(F.col("fill_rate") < 0.6, "low_fill"), F.when(F.col("rejected") > 0, "rejects"), F.when(F.abs(F.round("slip_bps", 6)) > 15, "slippage")))
    return g.withColumn("signature", F.array_join(F.array_sort(alarms), "|"))


def signature_changes(rows: DataFrame, order: str = "session") -> DataFrame:
    """Rows whose alarm signature differs from the row before."""
    w = Window.orderBy(order)
    return rows.withColumn("before", F.lag("signature").over(w)).where(F.col("before").isNull() | (F.col("before") != F.col("signature")))


def positions(fills: DataFrame) -> DataFrame:
    """(ticker, session, qty): running sum of signed fills."""
    signed = F.when(F.col("side") == "buy", F.col("filled_qty")).otherwise(-F.col("filled_qty"))
    day = fills.groupBy("ticker", "session").agg(F.sum(signed).alias("change"))
    return day.select("ticker", "session", F.sum("change").over(by("ticker", order="session").rowsBetween(Window.unboundedPreceding, 0)).alias("qty"))


def average_entry(fills: DataFrame) -> DataFrame:
    """(ticker, qty, avg_price) after all fills: adds are weighted in, reductions keep the price, a sign flip or a start from nothing resets it, nothing held has price 0.

    A day's fills, in order and from the quantity held before them, turn the price p into a + b * p; the days' pairs are then applied in turn. A fill is shuffled once and folded once.
    """
    signed = F.when(F.col("side") == "buy", F.col("filled_qty")).otherwise(-F.col("filled_qty"))
    day = ["ticker", "session"]
    rows = fills.where("filled_qty > 0").select(*day, "client_order_id", signed.cast("double").alias("q"), F.col("price").alias("p"))
    days = rows.repartition(*day).groupBy(*day).agg(F.sort_array(F.collect_list(F.struct("client_order_id", "q", "p"))).alias("_f"))
    before = F.coalesce(F.sum("_d").over(by("ticker", order="session").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    held = rows.groupBy(*day).agg(F.sum("q").alias("_d")).select(*day, before.alias("_q"))

    def fill(s: Column, x: Column) -> Column:
        after = s["q"] + x["q"]
        starts, adds = (s["q"] == 0) | (s["q"] * after < 0), s["q"] * x["q"] > 0
        a = F.when(starts, x["p"]).when(adds, ratio(s["a"] * s["q"] + x["p"] * x["q"], after)).otherwise(s["a"])
        b = F.when(starts, 0.0).when(adds, ratio(s["b"] * s["q"], after)).otherwise(s["b"])
        return F.struct(after.alias("q"), a.alias("a"), b.alias("b"))

    start = F.struct(F.col("_q").alias("q"), F.lit(0.0).alias("a"), F.lit(1.0).alias("b"))
    steps = days.join(held, day).select(*day, F.aggregate("_f", start, fill).alias("_s")).select("ticker", F.struct("session", "_s.q", "_s.a", "_s.b").alias("_s"))
    turn = steps.groupBy("ticker").agg(F.sort_array(F.collect_list("_s")).alias("_s"))  # a row per day
    price = F.aggregate("_s", F.lit(0.0), lambda p, s: s["a"] + s["b"] * p)
    qty = F.element_at("_s", -1)["q"]
    return turn.select("ticker", qty.alias("qty"), F.when(qty == 0, 0.0).otherwise(price).alias("avg_price"))


def trailing_slippage(fills: DataFrame, n: int) -> DataFrame:
    """Mean over each ticker's n latest fills; fresh marks tickers with a fill in the last 30 days of the table."""
    s = slippage(fills).withColumn("_r", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("session"), F.desc("client_order_id"))))
    newest = fills.agg(F.max("session").alias("_newest"))
    g = s.where(F.col("_r") <= n).groupBy("ticker").agg(F.count("*").alias("n"), F.avg("slip_bps").alias("mean_bps"), F.max("session").alias("last"))
    return g.crossJoin(F.broadcast(newest)).withColumn("fresh", F.col("last") >= F.date_sub("_newest", 30)).drop("_newest")


def breach_streak(rows: DataFrame, limit: float) -> DataFrame:
    """Per ticker and session with fills: how many sessions in a row |slip| exceeded the limit; sessions without fills hold."""
    d = slippage(rows).groupBy("ticker", "session").agg(F.avg("slip_bps").alias("slip_bps"))
    out = (F.abs("slip_bps") > limit).cast("int")
    w = by("ticker", order="session").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_seg", F.sum(1 - out).over(w))
    return d.withColumn("streak", F.sum(out).over(Window.partitionBy("ticker", "_seg").orderBy("session").rowsBetween(Window.unboundedPreceding, 0))).drop("_seg")


def completeness(expected: DataFrame, rows: DataFrame, recon: DataFrame) -> DataFrame:
    a, b = rows.select("session").distinct().withColumn("a", F.lit(1)), recon.select("session").distinct().withColumn("b", F.lit(1))
    s = F.coalesce("a", F.lit(0)) + F.coalesce("b", F.lit(0))
    return expected.join(a, "session", "left").join(b, "session", "left").select("session", F.when(s == 2, "HEALTHY").when(s == 1, "PARTIAL").otherwise("MISSING").alias("state"))


def whole_shares(targets: DataFrame) -> DataFrame:
    """Dollars over price to whole shares, half to even, and the weight that they come to."""
    return targets.withColumn("shares", F.bround(ratio(F.col("dollars"), F.col("price")))).withColumn("effective", F.col("shares") * F.col("price"))


def foreign(positions: DataFrame, targets: DataFrame) -> DataFrame:
    """Held names that no target has, with their signed and gross value."""
    f = positions.where("qty <> 0").join(targets.select("ticker").distinct(), "ticker", "left_anti")
    return f.select("ticker", "qty", (F.col("qty") * F.col("price")).alias("value"), F.abs(F.col("qty") * F.col("price")).alias("gross"))


def route(targets: DataFrame) -> DataFrame:
    """Dollars per account and ticker; shared marks tickers that land in more than one account."""
    g = targets.groupBy("account", "ticker").agg(F.sum("dollars").alias("dollars"))
    return g.withColumn("shared", F.count("*").over(Window.partitionBy("ticker")) > 1)


def carry_snapshot(old: DataFrame, new: DataFrame, keys: list[str], kept: list[str]) -> DataFrame:
    """new's rows with the stored values of the kept columns wherever old has them."""
    o = old.select(*keys, *[F.col(c).alias(f"_{c}") for c in kept])
    return new.join(o, keys, "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in kept else F.col(c) for c in new.columns])


def prefer_live(rows: DataFrame) -> DataFrame:
    """Of a book's rows of one date the live one, else the dry one; rows without a return don't count."""
    order = Window.partitionBy("book", "date").orderBy((F.col("mode") != "live").cast("int"))
    return rows.where("ret is not null").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def side_split(fills: DataFrame, tape: DataFrame) -> DataFrame:
    """Mean slippage by side on sessions whose week's tape rose or fell."""
    t = tape.where("ret is not null").select(F.col("date").alias("week"), F.when(F.col("ret") > 0, "up").otherwise("down").alias("tape"))
    return slippage(fills).join(t, "week").groupBy("side", "tape").agg(F.count("*").alias("fills"), F.avg("slip_bps").alias("mean_bps"))


def gate(rows: DataFrame, checks: dict[str, str]) -> DataFrame:
    """PASS if all conditions (name: SQL boolean) hold, FAIL if one doesn't, INCONCLUSIVE if one can't be told; the first that failed is named."""
    each = [F.expr(c) for c in checks.values()]
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in zip(checks, each, strict=True)]))
    unknown = sum((c.isNull().cast("int") for c in each), F.lit(0))
    return rows.withColumn("binding", F.get(failed, F.lit(0))).withColumn("verdict", F.when(F.size(failed) > 0, "FAIL").when(unknown > 0, "INCONCLUSIVE").otherwise("PASS"))


def slippage_alarms(means: DataFrame, limit: float, least: int, full: int) -> DataFrame:
    """means: (ticker, n, mean_bps, fresh). untested under `least` fills, stale without a fresh one, provisional under `full`, breach beyond the limit, else ok. A mean at the limit isn't beyond it, whichever way its sum was rounded."""
    beyond = F.abs("mean_bps") - limit > 1e-9
    state = F.when(F.col("n") < least, "untested").when(~F.col("fresh"), "stale").when(beyond, F.when(F.col("n") < full, "provisional_breach").otherwise("breach")).when(F.col("n") < full, "provisional")
    return means.withColumn("alarm", F.coalesce(state, F.lit("ok")))


def paper_stats(nets: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """(book, nav, ticker, w, place): the level after the last date and the k largest holdings on it."""
    nav = nets.groupBy("book").agg(F.exp(F.sum(F.log1p("net"))).alias("nav"), F.max("date").alias("date"))
    x = held.join(nav, ["book", "date"]).where("w <> 0")
    place = F.row_number().over(Window.partitionBy("book").orderBy(F.desc(F.abs("w")), "ticker"))
    return x.withColumn("place", place).where(F.col("place") <= k).select("book", "nav", "ticker", "w", "place")


def reconcile_exact(fills: DataFrame, n: int, tolerance: float) -> DataFrame:
    """(ticker, session, gap, drag, settled): shares ordered less shares filled so far, signed cost of the last n sessions, and whether the gap is within tolerance."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    cost = F.when(F.col("filled_qty") > 0, sign * (F.col("price") - F.col("close")) * F.col("filled_qty")).otherwise(0.0)
    day = fills.groupBy("ticker", "session").agg(F.sum(sign * (F.col("qty") - F.col("filled_qty"))).alias("_g"), F.sum(cost).alias("_c"))
    w = by("ticker", order="session")
    out = day.withColumn("gap", F.sum("_g").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("drag", F.sum("_c").over(w.rowsBetween(-(n - 1), 0)))
    return out.select("ticker", "session", "gap", "drag", (F.abs("gap") <= tolerance).alias("settled"))


def drift_exec_split(fills: DataFrame, opens: DataFrame, bound: float) -> DataFrame:
    """Mean slippage per ticker split at the open: drift (close to open) and execution (open to fill), withheld beyond the bound or without an open."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    x = fills.where("filled_qty > 0").join(opens, ["ticker", "week"], "left")
    x = x.withColumn("_d", sign * (F.col("open") / F.col("close") - 1) * 1e4).withColumn("_e", sign * (F.col("price") - F.col("open")) / F.col("close") * 1e4)
    ok = F.col("open").isNotNull() & (F.abs("_d") <= bound)
    return x.groupBy("ticker").agg(F.count("*").alias("fills"), F.count_if(ok).alias("split"), F.avg(F.when(ok, F.col("_d"))).alias("drift_bps"), F.avg(F.when(ok, F.col("_e"))).alias("exec_bps"))


def reconcile_detail(fills: DataFrame, classes: DataFrame, silent: int = 3) -> DataFrame:
    """Per session: share of the ordered quantity that was cancelled, fill rates of two classes of names, orders left open by position, drag of the fills in the money traded, sessions in
    a row whose fills cancel out, and the alarms. classes: (ticker, core)."""
    sign = F.when(F.col("side") == "buy", 1.0).otherwise(-1.0)
    x = fills.join(F.broadcast(classes), "ticker")  # a row per name
    rate = lambda c: ratio(F.sum(F.when(c, F.col("filled_qty"))), F.sum(F.when(c, F.col("qty"))))
    g = x.groupBy("session").agg(
        ratio(F.sum(F.when(F.col("status") != "rejected", F.col("qty") - F.col("filled_qty"))), F.sum("qty")).alias("cancelled"), rate(F.col("core")).alias("core_rate"), rate(~F.col("core")).alias("other_rate"),
        F.sum(F.abs(F.col("qty") - F.col("filled_qty"))).alias("open_qty"), ratio(F.sum(sign * (F.col("price") - F.col("close")) * F.col("filled_qty")), F.sum(F.col("filled_qty") * F.col("close"))).alias("drag"), F.sum(sign * F.col("filled_qty")).alias("net_qty"),
    )
    days = Window.orderBy("session")  # one row per session
    g = g.withColumn("_flat", (F.abs("net_qty") < 30).cast("int")).withColumn("_seg", F.sum(1 - F.col("_flat")).over(days))
    g = g.withColumn("flat_streak", F.sum("_flat").over(Window.partitionBy("_seg").orderBy("session")))
    alarms = F.array_compact(F.array(F.when(F.col("cancelled") > 0.3, "cancels"), F.when(F.round(F.abs(F.col("core_rate") - F.col("other_rate")), 9) > 0.5, "classes"), F.when(F.col("flat_streak") >= silent, "silent")))
    return g.withColumn("alarms", F.array_join(alarms, "|")).drop("_flat", "_seg")


def order_outcomes(fills: DataFrame, most_rejects: float = 0.1) -> DataFrame:
    """(session, n_orders, n_fills, n_partial, n_rejects, n_canceled, reject_rate, fill_rate, alarm): one's own cancels are neither orders nor rejects, but counted; a session of cancels only has no rates and no alarm."""
    gone = F.col("status") == "canceled"
    g = fills.groupBy("session").agg(
        F.count_if(~gone).alias("n_orders"), F.count_if(~gone & (F.col("filled_qty") > 0)).alias("n_fills"), F.count_if(F.col("status") == "partially_filled").alias("n_partial"), F.count_if(F.col("status") == "rejected").alias("n_rejects"),
        F.count_if(gone).alias("n_canceled"), ratio(F.sum(F.when(~gone, F.col("filled_qty"))), F.sum(F.when(~gone, F.col("qty")))).alias("fill_rate"),
    )
    rate = ratio(F.col("n_rejects").cast("double"), F.col("n_orders").cast("double"))
    return g.withColumn("reject_rate", rate).withColumn("alarm", F.coalesce(F.col("reject_rate") > most_rejects, F.lit(False)))
