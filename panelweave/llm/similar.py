"""Near-duplicate texts by SimHash: families of texts whose 5-word shingle sets have a Jaccard similarity of at least 0.8.

Texts with equal sets are one class. Two classes meet when all `ROWS` minima of one of `BANDS` bands of MinHash agree, which at similarity 0.8 fails for
all bands with probability (1 - 0.8^4)^32, about 5e-8. Where they meet, the pivot table of Hamming distances between SimHash fingerprints discards;
those that differ in more than `FAR` bits (at similarity 0.8 about 10 of 64 are expected, 27 or more with probability 2e-7) are no candidates. A spanning forest of
the candidates leaves each task. The sets of candidates that hang together then come together once, in one task or dealt out as pairs of chunks,
and the exact sets decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import bitmap, cut, id_and_text, maybe_in, record, slices, texts_of
from panelweave.llm.components import components
from panelweave.llm.simhash import _mixed, majority, meeting_links, pairs_of_chunks

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Similarity 0.8 as a fraction, so that the comparison is one of whole numbers.
LEAST = (4, 5)
FAR = 26
#: Texts and shingles that a task compares at once come from two chunks of about this size.
CHUNK_TEXTS, CHUNK_SHINGLES = 256, 1 << 18
_CACHED_WORDS = 1 << 17
_COLUMNS = 2048
_A = (_mixed(BANDS * ROWS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = _mixed(BANDS * ROWS).astype(np.uint32)
_PLACE = _mixed(2 * max(SHINGLE, ROWS) + BANDS) | np.uint64(1)


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh64_intdigest

        value = xxh64_intdigest(word, 42)
        if len(self) < _CACHED_WORDS:
            self[word] = value
        return value


_words = _Words()


def _spread(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of the text's 5-word shingles, sorted; of a shorter text one hash, without words none."""
    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    own = np.fromiter(map(_words.__getitem__, words), np.uint64, n)
    size = min(n, SHINGLE)
    total = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        total += own[i : n - size + 1 + i] * _PLACE[i]
    return np.unique(_spread(total))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of minima."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    for i in range(0, len(x), _COLUMNS):
        np.minimum(least, (x[None, i : i + _COLUMNS] * _A[:, None] + _B[:, None]).min(axis=1), out=least)
    of_rows = _PLACE[SHINGLE : SHINGLE + ROWS]
    return _spread((least.reshape(BANDS, ROWS).astype(np.uint64) * of_rows).sum(axis=1, dtype=np.uint64) + _PLACE[-BANDS:])


def _sketches(texts: DataFrame) -> DataFrame:
    """(text_key, same, fp, size, keys) of each text: its set's hash, SimHash fingerprint, size and band keys (none without words)."""
    schema = pa.schema([("text_key", pa.int64()), ("same", pa.int64()), ("fp", pa.int64()), ("size", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        for batch in slices(batches, "text"):
            sets = [shingles(t) for t in texts_of(batch, "text")]
            same = np.array([xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            fps = np.array([majority(s) for s in sets], dtype=np.uint64).view(np.int64)
            keys = [bands(s).view(np.int64) if len(s) else None for s in sets]
            yield record(schema, [batch.column(0), pa.array(same), pa.array(fps), [len(s) for s in sets], pa.array(keys, pa.list_(pa.int64()))])

    return texts.select("text_key", "text").mapInArrow(run, "text_key long, same long, fp long, size long, keys array<long>")


def similar_pairs(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest (pairs of places) of the sets that are similar enough."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) < 2 or not sizes.all():
        return []
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    codes, starts = codes.ravel(), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    mark = np.zeros(int(codes.max()) + 1, np.int32)
    family, found = np.arange(len(sets)), []
    for i in range(len(sets)):
        others = family != family[i]
        if not others.any():
            break
        own = codes[starts[i] : starts[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[codes], starts)
        mark[own] = 0
        for j in np.flatnonzero(others & (shared * LEAST[1] >= (sizes + sizes[i] - shared) * LEAST[0])).tolist():
            if family[j] != family[i]:
                family[family == family[j]] = family[i]
                found.append((i, j))
    return found


def _verified(rows: DataFrame) -> DataFrame:
    """Links (a, b) between similar texts of a unit; rows (unit, node, text) of a unit stand together."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, held = None, {}

        def solved() -> pa.RecordBatch:
            nodes = list(held)
            pairs = similar_pairs(list(held.values()))
            return record(schema, [[nodes[i] for i, _ in pairs], [nodes[j] for _, j in pairs]])

        for batch in batches:
            for own, node, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != unit:
                    yield solved()
                    unit, held = own, {}
                held[node] = shingles(text)
        yield solved()

    return rows.mapInArrow(run, "a long, b long")


def similar_families(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(text_key, root) of each distinct text: texts that similar ones connect share a root, a text without a similar one is its own.

    text_key is XXH64 of the text, null as empty. Texts with equal shingle sets are similar, wordless ones among them; texts of fewer than five words
    have one shingle, all their words. An empty table gives an empty result.
    """
    texts = id_and_text(docs, id_col, text_col).select(F.coalesce("text", F.lit("")).alias("text")).select(F.xxhash64("text").alias("text_key"), "text")
    sketch = cut(_sketches(texts))
    classes = cut(sketch.groupBy("same").agg(F.min("text_key").alias("node"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("keys").alias("keys")))
    near = cut(components(meeting_links(classes.select("node", "fp", F.explode("keys").alias("key")), FAR)))
    member = near.join(classes.select("node", "size"), "node")
    chunks = F.greatest(F.ceil(F.count("*") / CHUNK_TEXTS), F.ceil(F.sum("size") / CHUNK_SHINGLES))
    member = cut(pairs_of_chunks(member.join(member.groupBy("root").agg(chunks.alias("chunks")), "root").select(F.col("root").alias("key"), "node", "chunks")))
    held = texts.where(maybe_in(bitmap(near, F.col("node")), F.col("text_key"))).groupBy(F.col("text_key").alias("node")).agg(F.first("text").alias("text"))
    rows = held.join(member, "node").select("unit", "node", "text")
    family = cut(components(_verified(rows.repartition("unit").sortWithinPartitions("unit"))))
    named = sketch.select("text_key", "same").distinct().join(classes.select("same", "node"), "same")
    return named.join(family, "node", "left").select("text_key", F.coalesce("root", "node").alias("root"))
