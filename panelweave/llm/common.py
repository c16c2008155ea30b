"""Helpers shared by the text operators."""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a Python worker handles at once (one document at least).
SLICE_BYTES = 2 << 20
#: Bits of a membership bitmap; 2^25 bits are 4 MB, whatever the input's size.
BITMAP_BITS = 25
#: Rows of an Arrow batch between the JVM and Python in the registered queries; texts are long, so few rows bound a worker's memory.
BATCH_ROWS = 1000
#: A key is hot if it holds more than this share of all rows; there are fewer hot keys than its inverse.
HOT_SHARE = 1 / 500


def bounded_batches(spark: SparkSession) -> SparkSession:
    """For applications, not operators: the session's Arrow batches hold BATCH_ROWS rows at most from now on."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, BATCH_ROWS)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about `limit` bytes of `column`."""
    for batch in batches:
        at = batch.schema.get_field_index(column)
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def texts_of(batch: pa.RecordBatch, column: str) -> list[str]:
    """The column as Python strings, null as empty."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def record(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    arrays = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, under fixed names, so that further columns can't clash."""
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as it takes to be new to the table."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> DataFrame:
    """The table with its columns named c0, c1, ...: Arrow functions don't take names with dots or the same name twice."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session is local."""
    sc = spark.sparkContext
    if folder := sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir():
        return folder
    if not sc.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and forget the lineage; survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def skewed_join(rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """rows joined with per_key, which has one row for each key; weight: how many of the `total` rows the key has. Evaluates rows twice.

    The rows of a hot key stay where they are: hot keys are fewer than 1 / HOT_SHARE, whatever the input, so their part of per_key is broadcast.
    """
    per_key = per_key.withColumn("_hot", F.col(weight) > total * HOT_SHARE)
    hot = per_key.where("_hot")
    marked = rows.join(F.broadcast(hot.select(*keys, "_hot")), keys, "left")
    some = marked.where("_hot").drop("_hot").join(F.broadcast(hot.drop("_hot")), keys)
    rest = marked.where("_hot is null").drop("_hot").join(per_key.where("not _hot").drop("_hot"), keys)
    return some.unionByName(rest)


def bitmap(df: DataFrame, hashed: Column, bits: int = BITMAP_BITS) -> np.ndarray:
    """A one-hash membership bitmap of a LONG column; at most 2^(bits-6) words of 64 bits reach the driver.

    A set bit may stand for several values: use it to discard what is surely absent.
    """
    slot = hashed.bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        df.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).cast("int").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("mask"))
        .toArrow()
    )
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    for batch in words.to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out.view(np.uint64)


def in_bitmap(words: np.ndarray, hashed: np.ndarray) -> np.ndarray:
    """Which of the uint64 values may have been put in."""
    slot = hashed & np.uint64(len(words) * 64 - 1)
    return (words[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def maybe_in(held: np.ndarray, key: Column) -> Column:
    """Whether a LONG column's value may be in the bitmap."""
    shared = SparkSession.getActiveSession().sparkContext.broadcast(held)

    @F.pandas_udf("boolean")
    def check(values):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(in_bitmap(shared.value, values.to_numpy(dtype=np.int64).view(np.uint64)))

    return check(key)
