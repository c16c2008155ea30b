"""Removal of repeated byte strings by prefix-free parsing.

Parse. Triggers are places whose rolling hash (of `GRAM` bytes) is the least within a window of `LENGTH` bytes, so every window has one and the
gaps are bounded, which a fixed residue of the hash would not promise. The run of windows that share a trigger (cut once, at `SPLIT`) is a phrase, about
one per 70 bytes; neighbours overlap by LENGTH - 1 bytes, so phrases are prefix-free and every window lies in exactly one. Equal texts are parsed once.

Dictionary. Distinct phrases with their number of occurrences in the parse. A phrase that occurs again repeats in all its windows. A phrase shares a
window with another one only if both have the core that all windows of a phrase contain; phrases whose core no other phrase has go no further.

Orders. What is left of the dictionary is sorted twice over the whole cluster by its bytes: by what follows the trigger (the suffix array of the parse, as
deep as a window needs it) and by what precedes it, read backwards (the suffix array of the dictionary's phrase ends). Neighbours in these orders
have the longest common strings, so two numbers say for each phrase which of its windows can be repeated at all.

Corpus order. A window is the `x` bytes before its trigger and the LENGTH - x that follow. In the order by what follows (ties by what precedes), windows
that a phrase shares with its neighbour are repeats. Of each such run the first window is its head; heads of equal windows that stand apart
there are few and are merged by name (a 128-bit hash). Sorts split a frequent core over many tasks; names are counted with partial sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import bitmap, cut, id_and_text, in_bitmap, maybe_in, record, skewed_join, slices

LENGTH = 200
GRAM = 8
SPLIT = (LENGTH - GRAM + 1) // 2 + 1
SLICE = 1 << 20


def _owners(data: np.ndarray) -> np.ndarray:
    """The trigger of each window of LENGTH bytes: the place of its least GRAM-byte hash, the leftmost if tied."""
    n = len(data) - GRAM + 1
    with np.errstate(over="ignore"):
        key = np.zeros(n, np.uint64)
        for j in range(GRAM):
            key = key << np.uint64(8) | data[j : j + n]
        key *= np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
    key = (key >> np.uint64(32)) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    size, goal = 1, LENGTH - GRAM + 1
    while 2 * size <= goal:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    key = np.minimum(key[: len(key) - (goal - size)], key[goal - size :])
    return (key & np.uint64(0xFFFFFFFF)).astype(np.int64)


def phrases(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that stand one behind the other: each phrase's text, first window, number of windows and trigger."""
    none = np.empty(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none
    owner = _owners(data)
    start = np.arange(len(owner))
    doc = np.searchsorted(ends, start, "right")
    valid = start + LENGTH <= ends[doc]
    late = owner - start >= SPLIT
    new = np.empty(len(start), bool)
    new[0] = True
    new[1:] = (owner[1:] != owner[:-1]) | (late[1:] != late[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(start)))
    keep = valid[first]
    first, size = first[keep], size[keep]
    return doc[first], first, size, owner[first]


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _joined(column: pa.Array) -> tuple[bytes, np.ndarray]:
    """The texts' bytes one behind the other, and where each ends."""
    lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return b"".join(pc.fill_null(column.cast(pa.binary()), b"").to_pylist()), np.cumsum(lengths)


def _phrase_rows(texts: DataFrame, held: np.ndarray | None = None) -> DataFrame:
    """The parse: (core, full, t1, t2, at, n, copies) of each phrase: hashes of its core and its whole, its text, first window, number of windows."""
    shared = texts.sparkSession.sparkContext.broadcast(held)
    schema = pa.schema([(c, pa.int64()) for c in ("core", "full", "t1", "t2")] + [("at", pa.int32()), ("n", pa.int32()), ("copies", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as h

        own = shared.value
        for batch in slices(batches, "text", SLICE):
            joined, ends = _joined(batch.column(0))
            doc, first, size, trigger = phrases(np.frombuffer(joined, np.uint8), ends)
            late = trigger - first >= SPLIT
            left = np.where(late, trigger - SPLIT, trigger)
            right = np.where(late, trigger + GRAM, trigger + LENGTH - SPLIT + 1)
            core = np.array([h(joined[a:b], k) for a, b, k in zip(left.tolist(), right.tolist(), late.tolist(), strict=True)], dtype=np.uint64)
            if own is not None:
                keep = in_bitmap(own, core)
                core, doc, first, size, trigger = core[keep], doc[keep], first[keep], size[keep], trigger[keep]
            full = [h(joined[a : a + n + LENGTH - 1], t - a) for a, n, t in zip(first.tolist(), size.tolist(), trigger.tolist(), strict=True)]
            at = first - np.concatenate([[0], ends])[doc]
            row = pa.array(doc)
            yield record(schema, [pa.array(core.view(np.int64)), _signed(full), *(batch.column(i).take(row) for i in (1, 2)), pa.array(at), pa.array(size), batch.column(3).take(row)])

    return texts.select("text", "t1", "t2", "copies").mapInArrow(run, "core long, full long, t1 long, t2 long, at int, n int, copies long")


_PHRASE = "twice boolean, t1 long, t2 long, at int, late boolean, lead int, n int, after binary, before binary"
_PHRASE_FIELDS = [("twice", pa.bool_()), ("t1", pa.int64()), ("t2", pa.int64()), ("at", pa.int32()), ("late", pa.bool_()), ("lead", pa.int32()), ("n", pa.int32()), ("after", pa.binary()), ("before", pa.binary())]


def _contexts(needed: DataFrame) -> DataFrame:
    """The dictionary's bytes: rows of text and its needed phrases become a row for each, split at the trigger; before reads backwards."""
    schema = pa.schema(_PHRASE_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            rows = []
            for text, t1, t2, wanted in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                raw = text.encode()
                _, first, size, trigger = phrases(np.frombuffer(raw, np.uint8), np.array([len(raw)]))
                own = {a: (n, t) for a, n, t in zip(first.tolist(), size.tolist(), trigger.tolist(), strict=True)}
                for w in wanted:
                    at, (n, t) = w["at"], own[w["at"]]
                    rows.append((w["twice"], t1, t2, at, t - at >= SPLIT, t - at, n, raw[t : at + n + LENGTH - 1], raw[at:t][::-1]))
            yield record(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * len(schema))

    return needed.mapInArrow(run, _PHRASE)


#: More than any common length: what is not known at the edge of a sorted partition.
UNKNOWN = 1 << 16


def _common(strings: list[bytes]) -> np.ndarray:
    """The length of the longest common prefix of each string and the next."""
    sizes = np.array([len(s) for s in strings])
    width = int(sizes.max(initial=0)) + 1
    wide = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in strings), np.uint8).reshape(len(strings), width)
    differs = wide[1:] != wide[:-1]
    differs[:, -1] = True
    return np.minimum(differs.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1]))


def _with_neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of a sorted partition with the lengths that what follows (column 0) and what precedes (1) has in common with the row before and the row behind.

    The two arrays have a column for each of the two neighbours: unknown at the partition's edges, zero beyond a change of `late`.
    """
    last: pa.RecordBatch | None = None
    edge = np.full((1, 2), UNKNOWN)
    before = edge  # of the row held back: what it has in common with the one before it

    def lengths(batch: pa.RecordBatch) -> np.ndarray:
        late = batch.column("late").to_numpy(zero_copy_only=False)
        same = late[1:] == late[:-1]
        return np.stack([_common(batch.column(c).to_pylist()) * same for c in ("after", "before")], axis=1).reshape(-1, 2)

    for batch in batches:
        if not batch.num_rows:
            continue
        both = pa.concat_batches([last, batch]) if last is not None else batch
        steps = np.concatenate([before, lengths(both)])
        if both.num_rows > 1:
            yield both.slice(0, both.num_rows - 1), steps[:-1], steps[1:]
        last, before = both.slice(both.num_rows - 1), steps[-1:]
    if last is not None:
        yield last, before, edge


def _with_reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds reach: the longest string before the trigger that another phrase has too; rows stand in the order of what precedes."""
    schema = pa.schema([*_PHRASE_FIELDS, ("reach", pa.int32())])
    for batch, one, other in _with_neighbours(batches):
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.maximum(one[:, 1], other[:, 1]).astype(np.int32))], schema=schema)


def _neighbouring_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs (t1, t2, at, n) of windows that a phrase shares with a neighbour, and the heads (win, weight, open: not yet a known repeat)."""
    from xxhash import xxh3_128_digest as h

    schema = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("win", pa.binary()), ("weight", pa.int32()), ("open", pa.bool_())])
    for batch, prev, behind in _with_neighbours(batches):
        lead, n = (batch.column(c).to_numpy().astype(np.int64) for c in ("lead", "n"))
        low, high = lead - n + 1, lead  # distances to the trigger of the phrase's last and first window
        furthest = np.minimum(high, batch.column("reach").to_numpy())
        least = np.maximum(low, LENGTH - np.maximum(prev[:, 0], behind[:, 0]))

        def shared(with_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            known = with_[:, 0] < UNKNOWN
            return np.where(known, np.maximum(low, LENGTH - with_[:, 0]), 1), np.where(known, np.minimum(high, with_[:, 1]), 0)  # noqa: B023

        (a, b), (c, d) = shared(prev), shared(behind)
        twice, starts = batch.column("twice").to_numpy(zero_copy_only=False), batch.column("at").to_numpy() + lead
        rows = []
        for i in np.flatnonzero((furthest >= least) | (b >= a) | (d >= c)).tolist():
            t1, t2, place = batch.column("t1")[i].as_py(), batch.column("t2")[i].as_py(), int(starts[i])
            if not twice[i]:
                rows += [(t1, t2, place - int(to), int(to - from_) + 1, None, None, None) for from_, to in ((a[i], b[i]), (c[i], d[i])) if to >= from_]
            heads = [x for x in range(int(least[i]), int(furthest[i]) + 1) if not a[i] <= x <= b[i]]
            if heads:
                after, before = batch.column("after")[i].as_py(), batch.column("before")[i].as_py()
                rows += [(t1, t2, place - x, 1, h(before[:x][::-1] + after[: LENGTH - x]), 2 if twice[i] else 1, not twice[i] and not c[i] <= x <= d[i]) for x in heads]
        yield record(schema, [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * len(schema))


def repeated_ranges(texts: DataFrame) -> DataFrame:
    """(t1, t2, ranges): of each text (distinct, with its number of copies) with repeats, the runs of window starts (at, n) that occur elsewhere.

    texts are distinct and not null; one shorter than a window, or without a repeat, has no row, and neither has an empty table. Texts count whole, however long; where equal windows tie, all are given.
    """
    shared = _phrase_rows(texts).groupBy("core").agg(F.sum("copies").alias("total"), (F.min("full") == F.max("full")).alias("alike")).where("total > 1").select("core", "alike")
    shared = cut(shared)
    rows = cut(_phrase_rows(texts, bitmap(shared, F.col("core"))).join(shared, "core"))
    mixed = rows.where("not alike").drop("alike")
    kinds = cut(mixed.groupBy("core", "full").agg((F.sum("copies") > 1).alias("twice"), F.count("*").alias("rows"), F.min(F.struct("t1", "t2", "at")).alias("one")))
    needed = cut(kinds.groupBy("one.t1", "one.t2").agg(F.collect_list(F.struct("twice", "one.at")).alias("wanted")))
    held = texts.where(maybe_in(bitmap(needed, F.col("t1")), F.col("t1")))
    dictionary = _contexts(held.join(needed, ["t1", "t2"]).select("text", "t1", "t2", "wanted"))
    backwards = dictionary.repartitionByRange("late", "before", "after").sortWithinPartitions("late", "before", "after").mapInArrow(_with_reach, f"{_PHRASE}, reach int")
    forwards = backwards.repartitionByRange("late", "after", "before").sortWithinPartitions("late", "after", "before")
    found = cut(forwards.mapInArrow(_neighbouring_repeats, "t1 long, t2 long, at int, n int, win binary, weight int, open boolean"))
    again = cut(found.where("win is not null").groupBy("win").agg(F.sum("weight").alias("weight"), F.count("*").alias("rows")).where("weight > 1").drop("weight"))
    apart = skewed_join(found.where("open").select("t1", "t2", "at", "n", "win"), again, ["win"], "rows", found.count()).select("t1", "t2", "at", "n")
    alike = rows.where("alike").select("t1", "t2", "at", "n")
    twice = skewed_join(mixed, kinds.where("twice").select("core", "full", "rows"), ["core", "full"], "rows", mixed.count()).select("t1", "t2", "at", "n")
    ranges = alike.unionByName(twice).unionByName(found.where("win is null").select("t1", "t2", "at", "n")).unionByName(apart)
    return ranges.groupBy("t1", "t2").agg(F.collect_set(F.struct("at", "n")).alias("ranges"))


def covered(ranges: list[tuple[int, int]]) -> list[list[int]]:
    """Maximal byte runs that windows starting in the ranges cover."""
    out: list[list[int]] = []
    for at, n in sorted(ranges):
        end = at + n - 1 + LENGTH
        if out and at <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([at, end])
    return out


def _distinct(texts: DataFrame, copied: DataFrame) -> DataFrame:
    """Each text of LENGTH bytes or more once, with its number of copies; only texts that may have copies are moved."""
    long_ones = texts.where(F.octet_length("text") >= LENGTH).select("text", "t1", "t2").withColumn("maybe", maybe_in(bitmap(copied, F.col("t1")), F.col("t1")))
    once = long_ones.where("not maybe").select("text", "t1", "t2", F.lit(1).cast("long").alias("copies"))
    some = long_ones.where("maybe").groupBy("t1", "t2").agg(F.first("text").alias("text"), F.count("*").alias("copies"))
    return once.unionByName(some.select("text", "t1", "t2", "copies"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed byte runs: start, end) and kept (the bytes that stay) of every row.

    A byte goes if a LENGTH-byte string that also starts elsewhere, in any row, covers it. Null texts count as empty; a text of any length is one
    text. Repeated rows, and different rows with the same text, are each other's repeats: all lose everything if they have LENGTH bytes. Among ties
    no copy is spared. Further columns of the table play no part. An empty table gives an empty result.
    """
    texts = id_and_text(docs, id_col, text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(LENGTH), "text")})
    copied = cut(texts.where(F.octet_length("text") >= LENGTH).groupBy("t1", "t2").agg(F.count("*").alias("copies")).where("copies > 1"))
    found = cut(repeated_ranges(_distinct(texts, copied)))
    maybe = maybe_in(bitmap(found, F.col("t1")), F.col("t1"))
    flagged = texts.withColumn("maybe", maybe)
    kind = found.schema["ranges"].dataType
    # a text with very many copies is one hot key on the left of an outer join, which adaptive execution splits
    with_ranges = flagged.where("maybe").join(found, ["t1", "t2"], "left").select("doc_id", "text", "ranges")
    without = flagged.where("not maybe").select("doc_id", "text", F.lit(None).cast(kind).alias("ranges"))
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", spans), ("kept", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            gone = [covered([(r["at"], r["n"]) for r in x or ()]) for x in batch.column(2).to_pylist()]
            kept = [b"".join(t[a:b] for a, b in zip([0, *(e for _, e in g)], [*(s for s, _ in g), len(t)], strict=True)) for t, g in zip(raw, gone, strict=True)]
            yield record(schema, [batch.column(0), [len(t) for t in raw], [[{"start": s, "end": e} for s, e in g] for g in gone], kept])

    return with_ranges.unionByName(without).mapInArrow(run, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
