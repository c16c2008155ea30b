"""Per-key state machines over a stream, and joins and finalised days that wait for a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelweave.operators.state import PAID_OUT

Step = Callable[[tuple, object], tuple[tuple, int | None]]


def state_machine(events: DataFrame, key: str, value: str, start: tuple, kinds: str, step: Step) -> DataFrame:
    """(key, event_id, out): step(state, value) gives the next state and what to emit (None: nothing) for each row of a key.

    Rows of one batch are taken in (ts, event_id) order; across batches the order of arrival stands, so feed bounded batches
    (maxFilesPerTrigger). One key's state is the tuple alone; kinds is its schema.
    """

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else start
        ids, outs = [], []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for event, v in zip(rows["event_id"], rows[value], strict=True):
            now, out = step(now, None if pd.isna(v) else v)
            if out is not None:
                ids.append(event)
                outs.append(out)
        state.update(now)
        yield pd.DataFrame({key: [name[0]] * len(ids), "event_id": ids, "out": outs})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, event_id long, out int", kinds, "append", GroupStateTimeout.NoTimeout)


def bands(entry: float, leave: float) -> Step:
    """Mean-reversion position: short from entry, long from -entry, flat within leave; null holds."""

    def step(s: tuple, v: object) -> tuple[tuple, int]:
        p = s[0]
        if v is not None:
            if p == 0:
                p = -1 if v >= entry else 1 if v <= -entry else 0
            elif abs(v) <= leave:
                p = 0
        return (p,), p

    return step


def counter(hit: Callable[[object], bool]) -> Step:
    """How many rows in a row have been hits; null holds."""

    def step(s: tuple, v: object) -> tuple[tuple, int]:
        n = s[0] if v is None else s[0] + 1 if hit(v) else 0
        return (n,), n

    return step


def on_change(s: tuple, v: object) -> tuple[tuple, int | None]:
    """Emits a value when it differs from the last one."""
    return s if v is None else (int(v),), None if v is None or s[0] == int(v) else int(v)


def ladder(limit: int) -> Callable[[int, tuple], tuple[int, str]]:
    """`state.terminal_events` for one row: the halted rows so far and (status, in_index, successor, event, open, floor, side) give the next count and the reason."""

    def step(days: int, row: tuple) -> tuple[int, str]:
        status, inside, successor, event, price, floor, side = row
        inside = inside is None or inside
        if event == "symbol_change" and successor is not None:
            return 0, "corporate_action_follow"
        if event in PAID_OUT:
            return 0, "corporate_action"
        if status == "tradable":
            return 0, "gap_stop" if side == "long" and price is not None and floor is not None and price < floor else "still_open"
        if status == "halted":
            return days + 1, "halt" if inside and days < limit else "quarantine"
        if status == "delisted" and not inside and successor is None:
            return 0, "delisted"
        return days, "quarantine"

    return step


def terminal_events(rows: DataFrame, limit: int = 5, key: str = "ticker") -> DataFrame:
    """(key, date, reason): the stream's form of `state.terminal_events`; the state of a name is its halted rows. Rows of a batch go in order of their date, later batches after earlier ones."""
    columns = ["status", "in_index", "successor", "event", "open", "floor", "side"]
    step = ladder(limit)

    def run(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days = state.get[0] if state.exists else 0
        own = pd.concat(list(frames)).sort_values("date")
        reasons = []
        for row in own[columns].itertuples(index=False):
            days, reason = step(days, tuple(None if pd.isna(v) else v for v in row))
            reasons.append(reason)
        state.update((days,))
        yield pd.DataFrame({key: name[0], "date": own["date"].to_numpy(), "reason": reasons})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, "date", *columns).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, date date, reason string", "days int", "append", GroupStateTimeout.NoTimeout)


def finished_days(events: DataFrame, key: str, value: str, embargo: str) -> DataFrame:
    """(key, day, n, total in ten-thousandths): a day is written once, when the newest event is `embargo` past its end; later arrivals don't rewrite it."""
    out = events.withWatermark("ts", embargo).groupBy(key, F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 10000).cast("long")).alias("total"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("day"), "n", "total")


def interval_join(orders: DataFrame, fills: DataFrame, key: str, within: str, late: str = "2 days") -> DataFrame:
    """(key, order_id, fill_id): fills of a key no earlier than the order and within the bound after it; both sides forget behind their watermarks."""
    a = orders.select(F.col(key).alias("_k"), F.col("event_id").alias("order_id"), F.col("ts").alias("ordered")).withWatermark("ordered", late)
    b = fills.select(key, F.col("event_id").alias("fill_id"), F.col("ts").alias("filled")).withWatermark("filled", late)
    return a.join(b, F.expr(f"_k = {key} and filled >= ordered and filled <= ordered + interval {within}")).select(key, "order_id", "fill_id")
