"""Connected components of a link table: blocks of links are contracted within tasks, then alternating large and small stars connect the blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import cut, record, skewed_join

#: Links that a task contracts at once.
BLOCK = 1 << 18


def smallest_reached(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each node of the links that is not the smallest of its component, and that smallest node."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    at = at.ravel()
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (apart := root[a] != root[b]).any():
        a, b = a[apart], b[apart]
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]
    rest = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[rest], nodes[root[rest]]


def _contracted(edges: DataFrame) -> DataFrame:
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def solved() -> pa.RecordBatch:
            u, v = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
            return record(schema, [pa.array(x) for x in smallest_reached(u, v)])

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= BLOCK:
                yield solved()
                held = []
        if held:
            yield solved()

    return edges.mapInArrow(run, "u long, v long")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every linked node with the smallest node that it reaches, roots included.

    Links are LONG pairs in any order; loops, repeats and nulls are ignored. A task holds BLOCK links at most; links of one block are done at once.
    Else each round is two grouped minima and two joins, in which the links of a hub stay where they are; the number of rounds
    grows with the logarithm of the longest path between blocks, and each round is checkpointed.
    """
    edges = cut(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    blocks = -(-edges.count() // BLOCK)
    edges = cut(_contracted(edges.coalesce(max(1, blocks))))
    seen, total = None, edges.count() if blocks > 1 else 0
    while total:
        tasks = -(-total // BLOCK)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("links"))
        large = skewed_join(both, low, ["u"], "links", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.distinct().coalesce(tasks))
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("links"))
        small = skewed_join(large, low, ["u"], "links", total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = cut(small.distinct().coalesce(tasks))
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen, total = now, now[0]
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
