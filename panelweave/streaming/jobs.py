"""Structured Streaming twins of the stateful operators.

Each job takes a streaming DataFrame; `settle` runs it over what is there (availableNow) and returns the table that the batch twin gives.
State lives in Spark's state store, results in the shared checkpoint folder; nothing is gathered on the driver.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType


def source(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A file stream over one table of a folder, a file in each batch; rows that come in a later batch are later rows, whatever their stamp."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").option("maxFilesPerTrigger", 1).parquet(sf_dir)


def folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base and not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{base or tempfile.mkdtemp(prefix='spark-')}/stream-{uuid.uuid4().hex}"


def arriving(rows: DataFrame, batch: str, batches: int) -> DataFrame:
    """A stream that brings the rows in as many batches, by a column that numbers them from 0; a batch without rows brings an empty file. The files stay in the shared folder."""
    spark, at = rows.sparkSession, folder(rows.sparkSession)
    columns = [c for c in rows.columns if c != batch]
    for i in range(batches):  # one after the other: a file stream takes files in order of their age
        rows.where(F.col(batch) == i).select(*columns).coalesce(1).write.mode("append").parquet(at)
    return spark.readStream.schema(rows.select(*columns).schema).option("maxFilesPerTrigger", 1).parquet(at)


def settle(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run to the end of what is there. append: the rows written; update: each key's last row; complete: the last table."""
    spark, at = stream.sparkSession, folder(stream.sparkSession)
    if mode == "append":
        stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{at}/out")

    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")  # a batch that runs again replaces itself

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(StructType([*stream.schema.fields, StructField("batch", IntegerType())])).parquet(f"{at}/out")
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("batch"))
        return rows.join(F.broadcast(last), "batch", "left_semi").drop("batch")
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*stream.columns), "batch").alias("r"))
    return newest.select("r.*")


def first_arrivals(events: DataFrame, *keys: str, horizon: str | None = None) -> DataFrame:
    """Keys, each once, when they first arrive. State holds every key seen, as long as the stream runs: it grows with the distinct keys, not with the rows.

    horizon bounds the state instead: a key is forgotten, and written again if it returns, when the newest event lies further ahead of its first.
    """
    if horizon is None:
        return events.dropDuplicates(list(keys)).select(*keys)
    return events.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(list(keys)).select(*keys)


def tumbling(events: DataFrame, key: str, value: str, width: str, late: str = "2 days") -> DataFrame:
    """First, last, lowest, highest, sum and count of each window."""
    at = F.struct("ts", "event_id")
    w = events.withWatermark("ts", late).groupBy(key, F.window("ts", width).alias("w"))
    out = w.agg(F.min_by(value, at).alias("open"), F.max_by(value, at).alias("close"), F.min(value).alias("low"), F.max(value).alias("high"), F.sum(F.round(F.col(value) * 10000).cast("long")).alias("volume"), F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "open", "close", "low", "high", "volume", "n")


def sliding(events: DataFrame, key: str, width: str, step: str, late: str = "2 days") -> DataFrame:
    """Count and volume (ten-thousandths of value) of each sliding window."""
    out = events.withWatermark("ts", late).groupBy(key, F.window("ts", width, step).alias("w")).agg(F.count("*").alias("n"), F.sum(F.round(F.col("value") * 10000).cast("long")).alias("volume"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n", "volume")


def sessions(events: DataFrame, key: str, gap: str, late: str = "2 days") -> DataFrame:
    out = events.withWatermark("ts", late).groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def embargoed_ledger(events: DataFrame, key: str, value: str, embargo: str) -> tuple[DataFrame, DataFrame]:
    """Finished days (key, day, n, total), each written once, and late restatements (key, day, late_n, late_total) of days that were finished before they came.

    A day is finished when the newest event of a batch is `embargo` past its end. What comes for it in later batches changes nothing that is written; it is put aside, so that it can be looked at.
    Every batch writes only into folders of its own number and reads those up to it, so a batch that runs again after a loss replaces what it wrote. total is in ten-thousandths.
    """
    spark, at = events.sparkSession, folder(events.sparkSession)
    kind = f"{key} {events.schema[key].dataType.simpleString()}, day timestamp, n long, total long"
    over = lambda newest: F.col("day") + F.expr("interval 1 day") <= newest - F.expr(f"interval {embargo}")

    def up_to(name: str, schema: str, batch: int) -> DataFrame:
        return spark.read.schema(f"{schema}, batch int").parquet(f"{at}/{name}").where(F.col("batch") <= batch)

    def put(rows: DataFrame, batch: int) -> None:
        write = lambda df, name: df.write.mode("overwrite").parquet(f"{at}/{name}/batch={batch}")
        before = up_to("newest", "newest timestamp", batch - 1).agg(F.max("newest")).first()[0] if batch else None  # one value a batch
        now = max((t for t in (before, rows.agg(F.max("ts")).first()[0]) if t is not None), default=None)
        sums = rows.groupBy(key, F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("n"), F.sum(F.round(F.col(value) * 10000).cast("long")).alias("total"))
        shut = over(F.lit(before)) if before is not None else F.lit(False)
        write(sums.where(shut), "late")
        write(sums.where(~shut), "parts")
        write(spark.createDataFrame([(now,)], "newest timestamp"), "newest")
        done = up_to("parts", kind, batch).where(~shut & (over(F.lit(now)) if now is not None else F.lit(False)))
        write(done.groupBy(key, "day").agg(F.sum("n").alias("n"), F.sum("total").alias("total")), "done")

    for name in ("parts", "late", "done"):  # so that there is a table even if nothing comes
        spark.createDataFrame([], kind).write.parquet(f"{at}/{name}/batch=-1")
    events.writeStream.foreachBatch(put).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    written = lambda name: spark.read.schema(kind).parquet(f"{at}/{name}")
    late = written("late").groupBy(key, "day").agg(F.sum("n").alias("late_n"), F.sum("total").alias("late_total"))
    return written("done"), late


def enrich(events: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """A stream joined with a static table."""
    return events.join(dimension, key)


def running_positions(events: DataFrame, key: str, quantity: str, price: str) -> DataFrame:
    """(key, n, qty, peak, avg_price): running sum of a quantity, its highest absolute value and the average price of what is held: adds are weighted in, reductions keep it,
    a sign flip or a start from nothing resets it. One state per key; rows in time order within a batch, later batches after earlier ones."""

    def step(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, qty, peak, mean = state.get if state.exists else (0, 0, 0, 0.0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for q, p in zip(rows[quantity].astype(int), rows[price], strict=True):
            after = qty + q
            if after == 0:
                mean = 0.0
            elif qty == 0 or qty * after < 0:
                mean = float(p)
            elif qty * q > 0:
                mean = (mean * qty + p * q) / after
            n, qty, peak = n + 1, after, max(peak, abs(after))
        state.update((n, int(qty), int(peak), mean))
        yield pd.DataFrame({key: [name[0]], "n": [n], "qty": [qty], "peak": [peak], "avg_price": [mean]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, n long, qty long, peak long, avg_price double", "n long, qty long, peak long, avg_price double", "update", GroupStateTimeout.NoTimeout)
