"""SimHash near-duplicates with pivot distance tables.

Equal fingerprints are one class. Distinct ones meet when they agree on two of six blocks of bits, which any two that
differ in at most four bits do. Where they meet, a table of Hamming distances to `PIVOTS` reference fingerprints is made;
pairs whose largest coordinate difference exceeds the threshold are discarded (the triangle inequality rules them
out), survivors are verified, and a spanning forest of the links leaves the task, so a family of n near copies sends n - 1
rows and not n^2. Meeting places with more than `CHUNK` members are dealt out as pairs of chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import cut, id_and_text, record, skewed_join, slices, texts_of
from panelweave.llm.components import components

SHINGLE = 4
MAX_BITS = 4
CHUNK = 2048
BLOCKS = (11, 11, 11, 11, 10, 10)


def _mixed(n: int) -> np.ndarray:
    """n well spread 64-bit values (splitmix64)."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


#: The reference fingerprints.
PIVOTS = _mixed(16)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; 0 without hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint(text: str) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles; 0 without words."""
    from xxhash import xxh64_intdigest as h

    words = text.encode().lower().split()  # bytes: lower-cases A-Z and splits at space and \t-\r only
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return h(joined, 42)
    ends = list(accumulate(map(len, words), lambda x, y: x + y + 1))
    starts = [0, *(e + 1 for e in ends)]
    return majority(np.array([h(joined[s:e], 42) for s, e in zip(starts, ends[SHINGLE - 1 :])], dtype=np.uint64))  # noqa: B905


def fingerprints(texts: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp) of each row, all LONG; fp holds the fingerprint's 64 bits."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("fp", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            fps = np.array([fingerprint(t) for t in texts_of(batch, "text")], dtype=np.uint64)
            yield record(schema, [batch.column(0), batch.column(2), pa.array(fps.view(np.int64))])

    return texts.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, fp long")


def _linked(unit: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest (pairs of places) of the links between rows of the same unit."""
    near = np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int16)  # the pivot distance table
    order = np.lexsort((near[:, 0], unit))
    unit, fps, near = unit[order], fps[order], near[order]
    parent = np.arange(len(fps))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    at, step = np.arange(len(fps) - 1), 1
    while len(at):
        to = at + step
        # rows of a unit stand in the order of the first coordinate: once it differs too much, it does further on
        at = at[(unit[at] == unit[to]) & (near[to, 0] - near[at, 0] <= max_bits)]
        to = at + step
        keep = np.abs(near[at, 1:] - near[to, 1:]).max(axis=1, initial=0) <= max_bits
        x, y = at[keep], to[keep]
        close = np.bitwise_count(fps[x] ^ fps[y]) <= max_bits
        x, y = x[close], y[close]
        apart = parent[x] != parent[y]
        for i, j in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            i, j = root(i), root(j)
            parent[max(i, j)] = min(i, j)
        if apart.any():
            while (up := parent[parent]) is not None and (up != parent).any():
                parent = up
        step += 1
        at = at[at + step < len(fps)]
    child = np.flatnonzero(parent != np.arange(len(fps)))
    return order[child], order[parent[child]]


def pairs_of_chunks(rows: DataFrame) -> DataFrame:
    """rows: (key, chunks, node, ...) become (unit, node, ...): each two nodes of a key share a unit, which holds about two of the key's chunks."""
    own = F.pmod(F.xxhash64("node"), F.col("chunks"))
    rest = [c for c in rows.columns if c not in ("key", "chunks")]
    each = rows.select("key", own.alias("_own"), *rest, F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("_other"))
    return each.select(F.xxhash64("key", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("unit"), *rest)


def meeting_links(keyed: DataFrame, max_bits: int) -> DataFrame:
    """keyed: (node, fp, key). Links (a, b) of nodes that share a key and whose fingerprints are within max_bits; enough of them to connect what is connected."""
    shared = keyed.groupBy("key").count().where("count > 1").select("key", F.ceil(F.col("count") / CHUNK).alias("chunks"))
    units = pairs_of_chunks(keyed.join(shared, "key").select("key", "chunks", "node", "fp"))
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def solved(unit: np.ndarray, nodes: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
        a, b = _linked(unit, fps.view(np.uint64), max_bits)
        return record(schema, [pa.array(nodes[a]), pa.array(nodes[b])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, nodes, fps = (np.empty(0, np.int64) for _ in range(3))
        for batch in batches:
            unit, nodes, fps = (np.concatenate([x, batch.column(i).to_numpy()]) for i, x in enumerate((unit, nodes, fps)))
            ready = int(np.searchsorted(unit, unit[-1])) if len(unit) else 0  # the last unit may go on
            if ready:
                yield solved(unit[:ready], nodes[:ready], fps[:ready])
                unit, nodes, fps = unit[ready:], nodes[ready:], fps[ready:]
        if len(unit):
            yield solved(unit, nodes, fps)

    return units.select("unit", "node", "fp").repartition("unit").sortWithinPartitions("unit").mapInArrow(run, "a long, b long")


def links(classes: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b) fingerprints within max_bits (4 at most) of each other; enough of them to connect what is connected."""
    if not 0 <= max_bits <= len(BLOCKS) - 2:
        raise ValueError(f"max_bits must be in 0..{len(BLOCKS) - 2}")
    starts = [0, *accumulate(BLOCKS)]
    block = [F.shiftrightunsigned("fp", starts[i]).bitwiseAND(F.lit((1 << n) - 1)) for i, n in enumerate(BLOCKS)]
    keys = [F.shiftleft(F.lit(k).cast("long"), 22).bitwiseOR(F.shiftleft(block[i], 11)).bitwiseOR(block[j]) for k, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))]
    return meeting_links(classes.select(F.col("fp").alias("node"), "fp", F.explode(F.array(*keys)).alias("key")), max_bits)


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest id reachable), text_key and component_key of every row.

    Null and wordless texts have fingerprint zero and are linked like any other. Repeated rows stay; a null id never is
    a component's id unless the component has no other. An empty table gives an empty result. text_key is XXH64 of the text (with the id it names a
    row), component_key a number that only rows of the same component share.
    """
    fps = cut(fingerprints(id_and_text(docs, id_col, text_col)))
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("rows")))
    rooted = components(links(classes, max_bits))
    linked = cut(classes.join(rooted, F.col("fp") == F.col("node")).select("fp", "first", "root"))
    lowest = linked.groupBy("root").agg(F.min("first").alias("low"), F.count("*").alias("size"))
    moved = skewed_join(linked, lowest, ["root"], "size", linked.count()).select("fp", "low", "root")
    # a linked class without an id still belongs to its root's component
    component = F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("low")).alias("component_id")
    ids = cut(classes.join(moved, "fp", "left").select("fp", "rows", component, F.coalesce("root", "fp").alias("component_key")))
    found = skewed_join(fps, ids, ["fp"], "rows", fps.count())
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key", "component_key")
