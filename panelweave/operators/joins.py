"""Joins that panels need and Spark has no single operator for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], on: str, right_on: str, value: str, direction: str = "backward", strict: bool = False) -> DataFrame:
    """left with `value` of right's nearest row on or before (backward) or on or after (forward) left's `on`; strict leaves equality out.

    One union, one shuffle on the keys and one ordered window: rows of a key need not fit in memory, and no range join is made.
    """
    back = direction == "backward"
    late = 1 if strict == back else 0  # on equal times: whether right's rows come after left's
    l = left.withColumns({"_t": F.col(on), "_side": F.lit(0 if late else 1), "_v": F.lit(None).cast(right.schema[value].dataType)})  # noqa: E741
    r = right.select(*keys, F.col(right_on).alias("_t"), F.lit(1 if late else 0).alias("_side"), F.col(value).alias("_v"), F.lit(True).alias("_right"))
    both = l.withColumn("_right", F.lit(False)).unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_t", "_side")
    found = F.last("_v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) if back else F.first("_v", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn(value, found).where(~F.col("_right")).drop("_t", "_side", "_v", "_right")


def band(events: DataFrame, rows: DataFrame, key: str, low: int, high: int) -> DataFrame:
    """Rows at event position + k, k in [low, high]: an equi join on (key, pos), never a range join."""
    around = events.select("*", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("k")).withColumn("pos", F.col("at") + F.col("k"))
    return around.join(rows, [key, "pos"], "left")


def pairs(rows: DataFrame, key: str, within: str | None, *on: str, value: str) -> DataFrame:
    """All a < b pairs of a key (within a group, if given) that meet on the `on` columns; a report over few keys, quadratic in their number."""
    a = rows.select(*on, F.col(key).alias("a"), F.col(value).alias("va"), *([F.col(within).alias("ga")] if within else []))
    b = rows.select(*on, F.col(key).alias("b"), F.col(value).alias("vb"), *([F.col(within).alias("gb")] if within else []))
    out = a.join(b, list(on)).where("a < b")
    return out.where("ga = gb").drop("ga", "gb") if within else out


def delta(target: DataFrame, held: DataFrame, key: str = "ticker") -> DataFrame:
    """Trades that lead from held to target, exits included; zero trades are left out."""
    both = target.select(key, F.col("qty").alias("target")).join(held.select(key, F.col("qty").alias("held")), key, "full")
    both = both.select(key, F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("held", F.lit(0.0)).alias("held")).withColumn("delta", F.col("target") - F.col("held"))
    return both.where("delta <> 0")


def gaps(a: DataFrame, b: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """Cells on which two tables differ by more than the tolerance, or that only one has."""
    both = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), keys, "full")
    return both.where((F.abs(F.col("x") - F.col("y")) > tolerance) | (F.col("x").isNull() != F.col("y").isNull()))
