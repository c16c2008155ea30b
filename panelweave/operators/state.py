"""Path-dependent positions: as windows where the state resets, as folds over a key's ordered rows where it doesn't."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, StructField, StructType

from panelweave.functions.columns import by

PAST = (Window.unboundedPreceding, 0)


def fold(df: DataFrame, keys: list[str], columns: list[str], start: object, step: Callable, out: str, kind: DataType, order: str = "date") -> DataFrame:
    """(keys, order, out): step(state, *columns) carried over a key's rows in order. Rows are sorted within partitions and streamed; one state is held at a time."""
    rows = df.select(*keys, order, *columns).repartition(*keys).sortWithinPartitions(*keys, order)
    width = len(keys) + 1
    arrow = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), start
        for batch in batches:
            names = zip(*(batch.column(i).to_pylist() for i in range(len(keys))), strict=True)
            values = zip(*(batch.column(width + i).to_pylist() for i in range(len(columns))), strict=True)
            states = []
            for name, row in zip(names, values, strict=True):
                if name != last:
                    last, state = name, start
                state = step(state, *row)
                states.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(states, arrow)], names=[*batch.schema.names[:width], out])

    return rows.mapInArrow(run, StructType([*(rows.schema[c] for c in (*keys, order)), StructField(out, kind)]))


def fold_days(rows: DataFrame, keys: list[str], columns: list[str], start: object, step: Callable, schema: StructType, order: str = "date") -> DataFrame:
    """As fold, but a step takes all rows of a key and date at once: step(state, key, date, list of columns' tuples) gives the next state and rows of `schema`. One date of one key is held."""
    rows = rows.select(*keys, order, *columns).repartition(*keys).sortWithinPartitions(*keys, order, *columns)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, day, held, state, out = None, None, [], start, []

        def close() -> None:
            nonlocal state
            if last is not None:
                state, made = step(state, last, day, held)
                out.extend(made)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                name, at = row[: len(keys)], row[len(keys)]
                if name != last or at != day:
                    close()
                    if name != last:
                        state = start
                    last, day, held = name, at, []
                held.append(row[len(keys) + 1 :])
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)
            out.clear()
        close()
        yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in out], schema=arrow)

    return rows.mapInArrow(run, schema)


def fold_vectors(rows: DataFrame, key: str, columns: list[str], start: Callable[[int], object], step: Callable, out: list[StructField], order: str = "date") -> DataFrame:
    """A fold over a key's dates whose state is vectors over all names: step(state, key, date, ids, values) gives the next state and a row of `out`, or None.

    rows: (key, order, ticker, columns). Names are numbered from 0, in their order; start gets their number. ids are the names with a row on the date, values one array of doubles for each column, NaN for null. A date's rows come
    together as one row of arrays before the fold, so what one key's task reads in turn is a row for each date, and its arithmetic is numpy's. An output of (ids, w) arrays is unfolded by `named`.
    """
    names = numbered_names(rows)
    size = names.count()
    cells = F.sort_array(F.collect_list(F.struct(F.coalesce("_id", F.lit(-1)).alias("_id"), *[F.col(c).cast("double").alias(c) for c in columns])))
    days = rows.join(names, "ticker", "left").groupBy(key, order).agg(cells.alias("_c")).select(key, order, F.col("_c._id").alias("_id"), *[F.col(f"_c.{c}").alias(c) for c in columns])
    kinds = [f for f in days.schema.fields if f.name in (key, order)]
    schema = StructType([*kinds, *out])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for batch in batches:
            made = []
            lists = [batch.column(i + 2) for i in range(len(columns) + 1)]
            for i, (name, at) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if last is None or name != last:
                    last, state = name, start(size)
                ids = lists[0][i].values.to_numpy(zero_copy_only=False)
                real = ids >= 0
                values = [pc.fill_null(c[i].values, float("nan")).to_numpy(zero_copy_only=False)[real] for c in lists[1:]]
                state, row = step(state, name, at, ids[real], values)
                if row is not None:
                    made.append((name, at, *row))
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=True)) for r in made], schema=arrow)

    return days.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, schema)


#: What a fold over vectors gives for a book: the names held and their weights.
HELD = [StructField("ids", ArrayType(IntegerType())), StructField("w", ArrayType(DoubleType()))]


def numbered_names(rows: DataFrame) -> DataFrame:
    """(ticker, _id): names in their order, from 0."""
    return rows.select("ticker").where("ticker is not null").distinct().withColumn("_id", (F.row_number().over(Window.orderBy("ticker")) - 1).cast("int"))  # one row per name


def named(folded: DataFrame, rows: DataFrame) -> DataFrame:
    """The folded rows with ids and w as (ticker, w), a row for each name."""
    each = folded.withColumn("_p", F.explode(F.arrays_zip("ids", "w"))).drop("ids", "w").withColumn("_id", F.col("_p.ids")).withColumn("w", F.col("_p.w")).drop("_p")
    return each.join(numbered_names(rows), "_id").drop("_id")


def band_positions(df: DataFrame, entry: float, leave: float, value: str = "s", key: str = "ticker") -> DataFrame:
    """position -1/0/1: short from value >= entry, long from value <= -entry, flat once |value| <= leave; null holds; never flips directly.

    Window only (entry > leave): a segment ends at each flat row, and within it the first entry decides.
    """
    v = F.col(value)
    w = by(key).rowsBetween(*PAST)
    flat = F.coalesce(F.abs(v) <= leave, F.lit(False))
    df = df.withColumn("_seg", F.sum(flat.cast("int")).over(w)).withColumn("_e", F.when(flat, None).when(v >= entry, -1).when(v <= -entry, 1))
    inside = Window.partitionBy(key, "_seg").orderBy("date").rowsBetween(*PAST)
    return df.withColumn("position", F.when(flat, 0).otherwise(F.coalesce(F.first("_e", ignorenulls=True).over(inside), F.lit(0)))).drop("_seg", "_e")


def band_positions_floor(df: DataFrame, entry: float, leave: float, floor: float, value: str = "s", key: str = "ticker") -> DataFrame:
    """As band_positions, and a long is also left at value <= floor (and not re-entered on that row): a fold."""

    def step(s: int, v: float | None) -> int:
        if v is None:
            return s
        if s == 0:
            return -1 if v >= entry else 1 if floor < v <= -entry else 0
        return 0 if abs(v) <= leave or (s == 1 and v <= floor) else s

    return fold(df, [key], [value], 0, step, "position", IntegerType())


def hysteresis(df: DataFrame, up: Column, down: Column, key: str = "ticker") -> DataFrame:
    """gate 1 after up, 0 after down, held in between; null before either."""
    mark = F.when(up, 1).when(down, 0)
    return df.withColumn("gate", F.last(mark, ignorenulls=True).over(by(key).rowsBetween(*PAST)))


def tolerance_band(df: DataFrame, width: float, target: str = "target", key: str = "ticker") -> DataFrame:
    """held: the target of the last row on which it was further than width from what was held; a null target holds."""
    return fold(df, [key], [target], 0.0, lambda s, x: x if x is not None and abs(x - s) > width else s, "held", DoubleType())


def partial_fill(df: DataFrame, share: float, target: str = "target", key: str = "ticker") -> DataFrame:
    """held moves by a share of the way to the target on each row."""
    return fold(df, [key], [target], 0.0, lambda s, x: s if x is None else s + share * (x - s), "held", DoubleType())


def halving_gate(df: DataFrame, high: float, low: float, n: int, value: str = "v", key: str = "ticker") -> DataFrame:
    """exposure 0.5 from value >= high until n rows in a row below low, else 1. State: rows still to wait (0: full)."""

    def step(s: float, v: float | None) -> float:
        if v is None:
            return s
        return float(n) if v >= high or (s > 0 and v >= low) else max(s - 1, 0.0)

    waits = fold(df, [key], [value], 0.0, step, "wait", DoubleType())
    return waits.withColumn("exposure", F.when(F.col("wait") > 0, 0.5).otherwise(1.0))


def event_hold(df: DataFrame, flag: Column, hold: int, key: str = "ticker") -> DataFrame:
    """active on the rows 1..hold after a flagged one."""
    w = by(key).rowsBetween(-hold, -1)
    return df.withColumn("active", F.coalesce(F.max(flag.cast("int")).over(w), F.lit(0)))


def blackout_entries(df: DataFrame, key: str = "ticker") -> DataFrame:
    """A run of equal position that begins in a mask stays zero until its first row outside; running positions stay."""
    w = by(key)
    new = F.coalesce(F.col("position") != F.lag("position").over(w), F.lit(True))
    df = df.withColumn("_run", F.sum(new.cast("int")).over(w))
    seen = F.max((~F.col("mask")).cast("int")).over(Window.partitionBy(key, "_run").orderBy("date").rowsBetween(*PAST))
    return df.withColumn("position", F.when(seen == 1, F.col("position")).otherwise(0)).drop("_run")


def tranches(df: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    """Mean of n tranches, each holding the weight it saw on its last own date (pos % n)."""
    held = [F.coalesce(F.last(F.when(F.col("pos") % n == k, F.col("w")), ignorenulls=True).over(by(key).rowsBetween(*PAST)), F.lit(0.0)) for k in range(n)]
    return df.withColumn("w", sum(held[1:], held[0]) / n)


def missed_trades(df: DataFrame, one_in: int, key: str = "ticker") -> DataFrame:
    """Weights that skip a deterministic tenth (or other share) of the rebalance dates and keep what they had."""
    traded = F.when((F.col("pos") * 48271) % 2147483647 % one_in != 0, F.col("w"))
    return df.withColumn("w", F.last(traded, ignorenulls=True).over(by(key).rowsBetween(*PAST)))


def halt_counter(df: DataFrame, limit: int, key: str = "ticker") -> DataFrame:
    """days: rows in a row without a price so far; state: tradable, halted, or quarantined after `limit`."""
    w = by(key).rowsBetween(*PAST)
    df = df.withColumn("_priced", F.count("close").over(w))
    days = F.count_if(F.col("close").isNull()).over(Window.partitionBy(key, "_priced").orderBy("date").rowsBetween(*PAST))
    return df.withColumn("days", days).withColumn("state", F.when(F.col("days") == 0, "tradable").when(F.col("days") < limit, "halted").otherwise("quarantined")).drop("_priced")


#: Reasons that close a position, and those of them that are a name's death.
CLOSING = ["delisted", "corporate_action", "corporate_action_follow", "gap_stop"]
DEATHS = ["delisted", "corporate_action", "gap_stop"]
#: Corporate actions that pay a holder out.
PAID_OUT = ["merger_cash", "acquisition_cash"]


def terminal_events(df: DataFrame, limit: int = 5, key: str = "ticker") -> DataFrame:
    """days, reason, keep and dead for each row of a held name: what happened to it, by rules in order of their certainty.

    df: (key, date, status, in_index, successor, event, open, floor, side). A corporate action decides first; then a tradable name is open still, unless a long has gapped under its floor; a halt is one for `limit` rows, then doubtful, as
    it is at once outside the index; a delisting counts outside the index without a successor only. All else is put in quarantine, which never closes a position.
    days: halted rows since the name last was tradable, paid out or gone; doubtful rows between neither count nor reset. Missing in_index means inside, a missing price no gap.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    inside, moved = F.coalesce("in_index", F.lit(True)), F.col("successor").isNotNull()
    follow, paid = yes(F.col("event") == "symbol_change") & moved, yes(F.col("event").isin(PAID_OUT))
    rung = lambda status: ~follow & ~paid & yes(F.col("status") == status)
    gone = rung("delisted") & ~inside & ~moved
    w = by(key).rowsBetween(*PAST)
    df = df.withColumn("_halted", rung("halted")).withColumn("_seg", F.count_if(follow | paid | rung("tradable") | gone).over(w))
    days = F.count_if(F.col("_halted")).over(Window.partitionBy(key, "_seg").orderBy("date").rowsBetween(*PAST))
    df = df.withColumn("days", F.when(F.col("_halted"), days).otherwise(0).cast("int"))
    gap = yes((F.col("side") == "long") & (F.col("open") < F.col("floor")))
    reason = F.when(follow, "corporate_action_follow").when(paid, "corporate_action").when(rung("tradable") & gap, "gap_stop").when(rung("tradable"), "still_open")
    reason = reason.when(F.col("_halted") & inside & (F.col("days") <= limit), "halt").when(gone, "delisted").otherwise("quarantine")
    df = df.withColumn("reason", reason).drop("_halted", "_seg")
    return df.withColumn("keep", ~F.col("reason").isin(CLOSING)).withColumn("dead", F.col("reason").isin(DEATHS))


def trades(df: DataFrame, key: str = "ticker") -> DataFrame:
    """Contiguous nonzero runs of a position: start, end, side, n and the sum of lagged-position P&L within."""
    w = by(key)
    df = df.withColumn("_new", F.coalesce(F.col("position") != F.lag("position").over(w), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    df = df.withColumn("_pnl", F.lead("ret").over(w) * F.col("position"))
    return df.where("position <> 0").groupBy(key, "_run").agg(F.first("position").alias("side"), F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("n"), F.sum(F.coalesce("_pnl", F.lit(0.0))).alias("pnl")).drop("_run")


def trade_stats(t: DataFrame) -> DataFrame:
    return t.groupBy("side").agg(F.count("*").alias("trades"), F.avg((F.col("pnl") > 0).cast("double")).alias("win_rate"), F.avg(F.col("n").cast("double")).alias("mean_hold"), F.sum("pnl").alias("pnl"))
