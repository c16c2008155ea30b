"""Approximate nearest neighbours by learned partitions.

On a bounded sample a neighbour graph is built and cut into balanced parts; a softmax classifier learns to tell a vector's part. Parts and sample grow
with the table up to MAX_PARTS and MAX_SAMPLE. Every row of the table is then put into its most probable part, a query looks into its most probable
ones, and all that it meets there is reranked by exact cosine. How many parts a query looks into is set on sampled queries that the classifier was not
fitted on, by the share of their neighbours in the sample that are found.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import cut, record

#: Rows that the index is fitted on: so many for each part, and at most; further rows set the number of probes.
ROWS_A_PART, MAX_SAMPLE, TUNED_ON = 64, 8192, 512
#: Rows of the table for each part, and parts at most.
PART_ROWS, MAX_PARTS = 256, 128
#: Rows from which the neighbour graph is built at a time.
_BLOCK = 256
GRAPH_DEGREE = 10
#: The share of neighbours within the sample that the probes must find; above the 0.9 that is promised.
AIM = 0.95
BASE_CHUNK, QUERY_CHUNK = 4096, 2048


@dataclass(frozen=True)
class Router:
    """weights: (dimension + 1, parts) of the classifier; probes: parts that a query looks into."""

    weights: np.ndarray
    probes: int

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return unit @ self.weights[:-1] + self.weights[-1]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _balanced(affinity: np.ndarray, room: int) -> np.ndarray:
    """Each row's best part that still has room; the rows that gain most by it come first."""
    n, parts = affinity.shape
    label, left, want = np.full(n, -1), np.full(parts, room), affinity.copy()
    while (open_ := np.flatnonzero(label < 0)).size:
        best = want[open_].argmax(axis=1)
        gain = want[open_, best]
        for p in np.unique(best):
            rows = open_[best == p]
            rows = rows[np.argsort(-gain[best == p], kind="stable")[: left[p]]]
            label[rows] = p
            left[p] -= len(rows)
        want[:, left == 0] = -np.inf
    return label


def partition_graph(unit: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Balanced parts of the sample's neighbour graph: rows move to the part of most of their neighbours, within a size limit."""
    degree = min(GRAPH_DEGREE, len(unit) - 1)
    blocks = []
    for i in range(0, len(unit), _BLOCK):
        near = unit[i : i + _BLOCK] @ unit.T
        near[np.arange(len(near)), i + np.arange(len(near))] = -np.inf
        blocks.append(np.argpartition(-near, degree - 1, axis=1)[:, :degree].astype(np.int32))
    neighbours = np.concatenate(blocks)
    centre = unit[np.random.default_rng(0).choice(len(unit), parts, replace=False)]
    affinity, label = unit @ centre.T, np.zeros(len(unit), int)
    for _ in range(rounds):
        label = _balanced(affinity, -(-len(unit) * 11 // (10 * parts)))
        member = np.eye(parts, dtype=unit.dtype)[label]
        centre = (member.T @ unit) / np.maximum(member.sum(axis=0), 1)[:, None]
        affinity = sum(member[neighbours[:, j]] for j in range(degree)) / degree + 0.5 * unit @ centre.T
    return label


def _classifier(unit: np.ndarray, label: np.ndarray, parts: int, rounds: int = 200) -> np.ndarray:
    x = np.hstack([unit, np.ones((len(unit), 1), unit.dtype)])
    goal, w = np.eye(parts, dtype=unit.dtype)[label], np.zeros((x.shape[1], parts), unit.dtype)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        z = x @ w
        p = np.exp(z - z.max(axis=1, keepdims=True))
        grad = x.T @ (p / p.sum(axis=1, keepdims=True) - goal) / len(x) + 1e-6 * w
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        w -= 0.4 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return w


def parts_of(rows: int) -> int:
    return max(1, min(MAX_PARTS, rows // PART_ROWS))


def fit_router(sample: np.ndarray, k: int, parts: int) -> Router:
    """sample: vectors, TUNED_ON of them last to set the probes if there are enough; k: neighbours asked for."""
    unit = _unit(sample).astype(np.float32)
    parts = min(parts, len(unit) // 16)
    if parts <= 1:
        return Router(np.zeros((sample.shape[1] + 1, 1)), 1)
    tuned = min(TUNED_ON, len(unit) // 4)
    fitted, asked = unit[:-tuned], unit[-tuned:]
    router = Router(_classifier(fitted, partition_graph(fitted, parts), parts), parts)
    own = router.logits(fitted).argmax(axis=1)
    near = asked @ fitted.T
    best = np.argpartition(-near, k - 1, axis=1)[:, :k] if k < len(fitted) else np.tile(np.arange(len(fitted)), (tuned, 1))
    place = np.argsort(np.argsort(-router.logits(asked), axis=1), axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    return Router(router.weights, int(needed[int(np.ceil(AIM * len(needed))) - 1]) + 1)


def best_of(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, base: np.ndarray, k: int) -> list[tuple[int, int, float]]:
    """Each query's k nearest of the base rows but itself: largest cosine, then smallest id. Equal vectors are scored once."""
    _, first, group = np.unique(base.view(np.dtype((np.void, base.shape[1] * 8))).ravel(), return_index=True, return_inverse=True)
    pairs = np.unique(np.stack([group.ravel(), ids], axis=1), axis=0)  # by group, then id
    starts = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
    # of equal vectors the k + 1 smallest ids are enough: k, and the query itself
    owners = [pairs[s : min(e, s + k + 1), 1] for s, e in zip(starts[:-1], starts[1:], strict=True)]
    distinct = base[first]
    size, query_size = np.sqrt((distinct * distinct).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    rough = (queries / query_size[:, None]) @ (distinct / size[:, None]).T
    kept = min(k + 1, rough.shape[1])
    least = np.partition(rough, rough.shape[1] - kept, axis=1)[:, rough.shape[1] - kept] - 1e-9
    out = []
    for q, query, norm, row, floor in zip(query_ids.tolist(), queries, query_size, rough, least, strict=True):
        at = np.flatnonzero(row >= floor)
        exact = (distinct[at] * query).sum(axis=1) / (size[at] * norm)
        found = sorted((-s, i) for a, s in zip(at, exact.tolist(), strict=True) for i in owners[a].tolist() if i != q)[:k]
        out += [(q, i, -s) for s, i in found]
    return out


def usable(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows whose vector is not null, holds finite numbers only and is not zero."""
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def nearest(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the k nearest rows found for each row whose id is divisible by `every`.

    Vectors that are null, zero or hold null or non-finite numbers take no part, nor do those without an id or not of the most common length.
    Repeated rows count once; a query never meets its own id. Fewer candidates than k: all that are found. Ties go to the smaller id. An
    empty table gives an empty result; vectors may have any length that all share, and further columns, whatever their names, aren't read.
    """
    rows = usable(table, id_col, vector_col).withColumn("dim", F.size("v"))
    common = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = common[0]["dim"] if common else 1
    rows = rows.where(F.col("dim") == dim).select("vec_id", "v")
    parts = parts_of(common[0]["count"] if common else 0)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MAX_SAMPLE, ROWS_A_PART * parts) + TUNED_ON).select("v").toPandas()["v"]
    router = fit_router(np.array(sample.tolist(), dtype=np.float64).reshape(-1, dim), k, parts) if len(sample) else Router(np.zeros((dim + 1, 1)), 1)
    schema = pa.schema([("vec_id", pa.int64()), ("parts", pa.list_(pa.int32())), ("v", pa.binary())])

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, dim)
            parts = np.argsort(-router.logits(_unit(v)), axis=1, kind="stable")[:, : router.probes]
            yield record(schema, [batch.column(0), parts.astype(np.int32).tolist(), [x.tobytes() for x in v]])

    routed = cut(rows.mapInArrow(route, "vec_id long, parts array<int>, v binary"))
    base = routed.select(F.col("parts")[0].alias("part"), "vec_id", "v")
    asked = routed.where(F.col("vec_id") % every == 0)
    asked = asked.select(F.explode("parts").alias("part"), "vec_id", "v")
    chunks = lambda df, size, name: df.groupBy("part").agg(F.ceil(F.count("*") / size).alias(name))  # noqa: E731  a row for each part: PARTS at most
    sizes = F.broadcast(chunks(base, BASE_CHUNK, "nb").join(chunks(asked, QUERY_CHUNK, "nq"), "part"))
    own = lambda n: F.pmod(F.xxhash64("vec_id"), F.col(n))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    base = base.join(sizes, "part").select("part", own("nb").alias("b"), each("nq").alias("q"), F.lit(False).alias("asked"), "vec_id", "v")
    asked = asked.join(sizes, "part").select("part", each("nb").alias("b"), own("nq").alias("q"), F.lit(True).alias("asked"), "vec_id", "v")
    result = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def rerank(block: pa.Table) -> pa.Table:
        is_query, ids = block["asked"].to_numpy(), block["vec_id"].to_numpy()
        v = np.frombuffer(b"".join(block["v"].to_pylist()), np.float64).reshape(-1, dim)
        found = best_of(ids[is_query], v[is_query], ids[~is_query], v[~is_query], k) if is_query.any() and not is_query.all() else []
        return pa.Table.from_batches([record(result, [list(c) for c in zip(*found, strict=True)] if found else [[], [], []])])

    # repeated rows of one id ask and answer more than once
    met = base.unionByName(asked).groupBy("part", "b", "q").applyInArrow(rerank, "query_id long, vec_id long, score double").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
