"""Benchmark decontamination by winnowing.

Of every `WINDOW` consecutive hashes of `GRAM` words the least is kept, so any shared run of GRAM + WINDOW - 1 = 10 words shares a kept
hash, at the same place in the run. Documents keep those hashes that a fixed-size bitmap of the benchmark's may hold; the hits are extended
to the 10-word windows around them, and only the windows' digests are joined. Items of fewer words are one window of their own length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import bitmap, cut, id_and_text, in_bitmap, record, skewed_join, slices, texts_of

GRAM, WINDOW = 5, 6
RUN = GRAM + WINDOW - 1
#: A-Z to a-z; what is no word byte to a space. All bytes of characters beyond ASCII are word bytes.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_FOLD).split()


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each `size` consecutive word hashes."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(n, size, dtype=np.uint64)
        for j in range(size):
            out = out * _STEP + hashes[j : j + n]
            out ^= out >> np.uint64(29)
        return out * _STEP


def _slide(values: np.ndarray, size: int, best: np.ufunc) -> np.ndarray:
    out = values[: len(values) - size + 1].copy()
    for j in range(1, size):
        best(out, values[j : j + len(out)], out=out)
    return out


def _kept(grams: np.ndarray) -> np.ndarray:
    """Which hashes are the least of some window; ties are all kept."""
    if len(grams) < WINDOW:
        return np.zeros(len(grams), bool)
    low = _slide(grams, WINDOW, np.minimum)
    edge = np.zeros(WINDOW - 1, np.uint64)
    return _slide(np.concatenate([edge, low, edge]), WINDOW, np.maximum) == grams


def _hashed(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _digest(words: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, win, size, gram): a row for each window of each item, with the kept hash by which it is found."""
    schema = pa.schema([("item_id", pa.int64()), ("win", pa.binary()), ("size", pa.int32()), ("gram", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            ids, wins, sizes, grams = [], [], [], []
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                words = words_of(text)
                if not words:
                    continue
                size = min(RUN, len(words))
                own = _grams(_hashed(words), GRAM if size == RUN else size)
                own = _slide(own, WINDOW, np.minimum) if size == RUN else own
                starts = range(len(words) - size + 1)
                ids += [item] * len(starts)
                wins += [_digest(words[s : s + size]) for s in starts]
                sizes += [size] * len(starts)
                grams += own.view(np.int64).tolist()
            yield record(schema, [ids, wins, sizes, grams])

    items = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return items.mapInArrow(run, "item_id long, win binary, size int, gram long").distinct()


def _candidates(texts: DataFrame, held: np.ndarray, sizes: list[int]) -> DataFrame:
    """doc_id, text_key, n_words and the windows that may be the benchmark's, each once with all its starts."""
    shared = texts.sparkSession.sparkContext.broadcast(held)
    wins = pa.list_(pa.struct([("win", pa.binary()), ("size", pa.int32()), ("starts", pa.list_(pa.int32()))]))
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n_words", pa.int64()), ("wins", wins)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, "text"):
            split = [words_of(t) for t in texts_of(batch, "text")]
            words = [w for ws in split for w in ws]
            ends = np.cumsum([len(ws) for ws in split], dtype=np.int64)
            hashes = _hashed(words)
            found: list[dict[tuple[int, bytes], list[int]]] = [{} for _ in split]
            for size in sizes:
                if size == RUN:
                    grams = _grams(hashes, GRAM)
                    at = np.flatnonzero(_kept(grams))
                    at = at[in_bitmap(own, grams[at])]
                    at = np.unique((at[:, None] - np.arange(WINDOW)[None, :]).ravel())
                else:
                    at = np.flatnonzero(in_bitmap(own, _grams(hashes, size)))
                at = at[at >= 0]
                doc = np.searchsorted(ends, at, "right")
                inside = doc < len(ends)
                at, doc = at[inside], doc[inside]
                inside = at + size <= ends[doc]
                first = np.concatenate([[0], ends[:-1]])
                for p, d in zip(at[inside].tolist(), doc[inside].tolist(), strict=True):
                    found[d].setdefault((size, _digest(words[p : p + size])), []).append(p - int(first[d]))
            rows = [[{"win": w, "size": k, "starts": s} for (k, w), s in x.items()] for x in found]
            yield record(schema, [batch.column(0), batch.column(2), [len(ws) for ws in split], rows])

    keyed = texts.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
    return keyed.mapInArrow(run, "doc_id long, text_key long, n_words long, wins array<struct<win:binary,size:int,starts:array<int>>>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, text_key, n_words, hits (sorted disjoint word spans that windows cover), n_hit and items (ids whose windows occur) of every row.

    Null and wordless texts have no words and no hits; wordless items are never found; an item without an id is found (hits) but not listed.
    Repeated rows each give a row; empty tables give no rows or no hits. Texts count whole, however long; further columns of either table, whatever their names, aren't read. text_key is XXH64 of the text: with doc_id it names a row.
    """
    windows = cut(benchmark_windows(benchmark, item_col, item_text_col))
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # ten values at most
    held = bitmap(windows, F.col("gram"))
    rows = cut(_candidates(id_and_text(docs, id_col, text_col), held, sizes).withColumn("uid", F.monotonically_increasing_id()))
    seen = rows.select("uid", F.explode("wins").alias("w")).select("uid", "w.*")
    # a window of a very common passage is one key of very many rows; the items that share a window are one list
    per_window = windows.groupBy("win").agg(F.collect_set("item_id").alias("owners")).join(seen.groupBy("win").agg(F.count("*").alias("rows")), "win")
    hit = cut(skewed_join(seen, cut(per_window), ["win"], "rows", seen.count()))
    spans = hit.select("uid", "size", F.explode("starts").alias("s")).select("uid", "s", (F.col("s") + F.col("size")).alias("e"))
    order = Window.partitionBy("uid").orderBy("s", "e")
    apart = F.col("s") > F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))
    runs = spans.withColumn("new", apart.cast("int")).withColumn("run", F.sum("new").over(order)).groupBy("uid", "run").agg(F.min("s").alias("start"), F.max("e").alias("end"))
    hits = runs.groupBy("uid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("hits"), F.sum(F.col("end") - F.col("start")).alias("n_hit"))
    items = hit.groupBy("uid").agg(F.array_distinct(F.flatten(F.collect_set("owners"))).alias("items"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    return (
        rows.select("uid", "doc_id", "text_key", "n_words")
        .join(hits, "uid", "left")
        .join(items, "uid", "left")
        .select("doc_id", "text_key", "n_words", F.coalesce("hits", none).alias("hits"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", F.array().cast("array<long>")).alias("items"))
    )
