"""Audit of how the sources of each language differ in their words, by in-mapper stripes.

Tasks fold whole documents into stripes: term -> (document frequency, occurrences by source). A task's stripes spill into the shuffle when they
outgrow MAX_ENTRIES, meet again by term, and are merged in key order, one stripe at a time. From the merged stripes of kept terms come totals,
probabilities and divergences. All arithmetic is on integers.

A pair of sources needs a sum over all kept terms, most of which neither or only one of them has. With c for the pair's value of a term that
neither has, the sum is (kept terms) * c, plus what changes where one source has the term (a function of its count alone, so counted once for
each count that occurs), plus a correction where both have it, which is folded within the tasks that read the stripes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelweave.llm.common import cut, record, slices

TERM = re.compile(rb"[a-z\x80-\xff]+")
SCALE = 10**9
#: A term is kept by a language of which so many documents have it.
MIN_DOCUMENTS = 3
#: Ranks of the terms of a source.
TOP_TERMS = 200
#: (term, source) entries of a task's stripes, and pairs of its sums, that are held before they spill into the shuffle.
MAX_ENTRIES, MAX_PAIRS = 400_000, 200_000
#: Pairs of a stripe's sources that are computed at once.
PAIRS_AT_ONCE = 500_000
#: Rows of one language that meet all its sources are dealt out over so many keys.
SALTS = 64
_ROWS_OUT = 20_000

_PARTIAL = pa.schema([("lang", pa.string()), ("term", pa.string()), ("df", pa.int64()), ("sources", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))])
_MERGED = "lang string, term string, df long, sources array<string>, counts array<long>"


def terms_of(text: bytes) -> list[bytes]:
    """Runs of letters A-Z, a-z and of characters beyond ASCII; only A-Z are lower-cased."""
    return TERM.findall(text.lower())  # of bytes: nothing but A-Z changes


_DF = -1


class Stripes:
    """lang -> term -> {_DF: document frequency, source's number: occurrences}."""

    def __init__(self) -> None:
        self.held: dict[str, dict[bytes, dict[int, int]]] = {}
        self.sources: dict[str, int] = {}
        self.entries = 0

    def fold(self, lang: str, source: str, text: bytes) -> None:
        held = self.held.setdefault(lang, {})
        own = self.sources.setdefault(source, len(self.sources))
        new = 0
        for term, n in Counter(terms_of(text)).items():
            stripe = held.get(term)
            if stripe is None:
                held[term] = {_DF: 1, own: n}
                new += 1
            else:
                stripe[_DF] += 1
                if own in stripe:
                    stripe[own] += n
                else:
                    stripe[own] = n
                    new += 1
        self.entries += new

    def spill(self) -> Iterator[pa.RecordBatch]:
        """All stripes; none are held afterwards."""
        names = pa.array(list(self.sources), pa.string())
        for lang, held in self.held.items():
            terms = list(held)
            for i in range(0, len(terms), _ROWS_OUT):
                some = terms[i : i + _ROWS_OUT]
                stripes = [held[t] for t in some]
                df = [x.pop(_DF) for x in stripes]
                ends = pa.array(np.cumsum([0, *map(len, stripes)]), pa.int32())
                sources = names.take(pa.array([k for x in stripes for k in x], pa.int64()))
                counts = pa.array([n for x in stripes for n in x.values()], pa.int64())
                lists = [pa.ListArray.from_arrays(ends, v) for v in (sources, counts)]
                yield record(_PARTIAL, [[lang] * len(some), pa.array(some, pa.binary()), df, *lists])
        self.held, self.sources, self.entries = {}, {}, 0


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stripes = Stripes()
    for batch in slices(batches, "text"):
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            stripes.fold(lang, source, text)
            if stripes.entries >= MAX_ENTRIES:
                yield from stripes.spill()
    yield from stripes.spill()


def _starts(rows: pa.Table) -> np.ndarray:
    """Where a new key begins."""
    lang, term = (rows.column(i) for i in (0, 1))
    same = pc.and_(*(pc.equal(c.slice(1), c.slice(0, len(c) - 1)) for c in (lang, term)))
    return np.flatnonzero(np.r_[True, ~same.to_numpy()])


def _one_each(rows: pa.Table, least: int) -> pa.Table:
    """Partial stripes, in order of their key, merged into one for each key of at least so many documents."""
    if not rows.num_rows:
        return rows
    starts = _starts(rows)
    df = np.add.reduceat(rows.column(2).to_numpy(), starts)
    kept = np.flatnonzero(df >= least)
    if not len(kept):
        return rows.slice(0, 0)
    sizes = np.diff(np.r_[starts, rows.num_rows])
    rank = np.repeat(np.cumsum(df >= least) - 1, sizes)
    some = rows.filter(pa.array(np.repeat(df >= least, sizes)))
    sources, counts = (some.column(i).combine_chunks() for i in (3, 4))
    width = sources.value_lengths().to_numpy()
    named = sources.flatten().dictionary_encode()
    code = np.repeat(rank[np.repeat(df >= least, sizes)], width) * len(named.dictionary) + named.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code = code[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
    total = np.add.reduceat(counts.flatten().to_numpy()[order], first)
    code = code[first]
    ends = pa.array(np.searchsorted(code, np.arange(len(kept) + 1) * len(named.dictionary)), pa.int32())
    lists = [pa.ListArray.from_arrays(ends, v) for v in (named.dictionary.take(pa.array(code % len(named.dictionary))), pa.array(total))]
    at = pa.array(starts[kept])
    return pa.table([rows.column(0).take(at), rows.column(1).take(at), pa.array(df[kept]), *lists], schema=_PARTIAL)


def _merged(least: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Partial stripes come in order of their key, so all but the last key's are whole; the last key's are merged and wait."""
        held, rows = [], 0
        for batch in batches:
            held.append(pa.RecordBatch.from_arrays(batch.columns, schema=_PARTIAL))
            rows += batch.num_rows
            if rows >= _ROWS_OUT:
                table = pa.Table.from_batches(held)
                last = int(_starts(table)[-1])
                yield from _one_each(table.slice(0, last), least).to_batches()
                held = _one_each(table.slice(last), 0).combine_chunks().to_batches()
                rows = 1
        if held:
            yield from _one_each(pa.Table.from_batches(held), least).to_batches()

    return run


def kept_stripes(docs: DataFrame, least: int = MIN_DOCUMENTS) -> DataFrame:
    """(lang, term, df, sources, counts): a row for each term that at least `least` of the language's documents have."""
    partial = docs.select("lang", "source", F.col("text").cast("binary").alias("text")).mapInArrow(_folded, _MERGED)
    # ordered by term first: languages are few, so their names would not tell rows apart
    return partial.repartition("lang", "term").sortWithinPartitions("term", "lang").mapInArrow(_merged(least), _MERGED)


def _p(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)); null where there is no term."""
    count, total, terms = (c.cast("decimal(20,0)") for c in (count, total, terms))
    return F.when(total + terms > 0, 1 + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (count + 1), total + terms))


def _f(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _np_f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each ordered pair of sources the sum, over the stripes that have both, of what replaces the two one-sided terms."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
    place: dict[tuple[str, str], int] = {}
    sums: dict[int, int] = {}

    def spill() -> Iterator[pa.RecordBatch]:
        names, rows = list(place), list(sums.items())
        sums.clear()
        for i in range(0, len(rows), _ROWS_OUT):
            some = [(names[k >> 32], names[k & 0xFFFFFFFF], v) for k, v in rows[i : i + _ROWS_OUT]]
            yield record(schema, [[a[0] for a, _, _ in some], [a[1] for a, _, _ in some], [b[1] for _, b, _ in some], [v for _, _, v in some]])

    for batch in batches:
        held = batch.column(1)
        size = held.value_lengths().to_numpy().astype(np.int64)
        entry = held.flatten()
        source, p, none = entry.field(0).to_pylist(), entry.field(1).to_numpy(), entry.field(2).to_numpy()
        langs = batch.column(0).to_pylist()
        own = np.fromiter((place.setdefault((lang, s), len(place)) for lang, s in zip([x for x, n in zip(langs, size.tolist(), strict=True) for _ in range(n)], source, strict=True)), np.int64, len(source))
        first, wide = np.repeat(np.cumsum(size) - size, size), np.repeat(size, size)  # of each entry's stripe
        ends = np.cumsum(wide)
        start = 0
        while start < len(own):
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
            n = wide[start:stop]
            left = np.repeat(np.arange(start, stop), n)
            right = np.repeat(first[start:stop], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            left, right = (x[left != right] for x in (left, right))
            value = _np_f(p[left], p[right]) - _np_f(p[left], none[right]) - _np_f(none[left], p[right]) + _np_f(none[left], none[right])
            code = own[left] << 32 | own[right]
            order = np.argsort(code, kind="stable")
            code, value = code[order], value[order]
            at = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.empty(0, np.int64)
            for k, v in zip(code[at].tolist(), np.add.reduceat(value, at).tolist() if len(at) else [], strict=True):
                sums[k] = sums.get(k, 0) + v
            start = stop
            if len(sums) >= MAX_PAIRS:
                yield from spill()
    yield from spill()


def _meet(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each row with each other source of its language (item, item_none), dealt out by a salt: languages are few and one may hold most rows."""
    others = groups.select("lang", F.col("source").alias("item"), F.col("none").alias("item_none"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(others, ["lang", "_salt"]).where(F.col("source") != F.col("item")).drop("_salt")


def divergences(docs: DataFrame, least: int = MIN_DOCUMENTS, top: int = TOP_TERMS, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language, part `term` the source's `top` terms that are
    more probable in it than in its language.

    p = 1 + floor(10^9 * (count + 1) / (N + V)) for a group's count of a term that at least `least` of its language's V kept terms' documents have, N the
    group's occurrences of kept terms; value is (p - q)^2 / q rounded down, q the other source's (summed over all kept terms) or the language's p.
    Ranks go by value, then by the item's UTF-8 bytes. Null text, lang and source count as empty. A repeated row is one more document. A
    group without kept terms has its pairs; a language without kept terms has pairs of value 0; a source alone in its language has none. An empty
    table gives none. Texts count whole, however long; further columns aren't read.
    """
    text = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text"))
    stripes = cut(kept_stripes(docs, least))
    entries = stripes.select("lang", "term", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("all"), F.explode(F.arrays_zip("sources", "counts")).alias("e"))
    entries = entries.select("lang", "term", "all", F.col("e.sources").alias("source"), F.col("e.counts").alias("count"))
    of_lang = entries.groupBy("lang").agg(F.sum("count").alias("lang_n"))
    of_lang = stripes.groupBy("lang").agg(F.count("*").alias("terms")).join(of_lang, "lang")
    groups = docs.select("lang", "source").distinct().join(entries.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n", "terms", "lang_n")])
    groups = cut(groups.withColumn("none", _p(F.lit(0), F.col("n"), F.col("terms"))))
    seen = entries.join(groups, ["lang", "source"]).withColumn("p", _p(F.col("count"), F.col("n"), F.col("terms")))

    q = _p(F.col("all"), F.col("lang_n"), F.col("terms"))
    more = seen.withColumn("q", q).where("p > q").select("lang", "source", F.col("term").alias("item"), _f(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    by_term = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)

    p, none, item_none = F.col("p"), F.col("none"), F.col("item_none")
    least_value = _meet(groups.select("lang", "source", "none", "terms"), groups).select("lang", "source", "item", F.coalesce(F.col("terms") * _f(none, item_none), F.lit(0).cast("long")).alias("value"))
    cells = seen.groupBy("lang", "source", "none", "p").agg(F.count("*").alias("cell"))
    one = _meet(cells, groups).groupBy("lang", "source", "item").agg(
        F.sum(F.col("cell") * (_f(p, item_none) - _f(none, item_none))).alias("mine"), F.sum(F.col("cell") * (_f(item_none, p) - _f(item_none, none))).alias("theirs")
    )
    mine = one.select("lang", "source", "item", F.col("mine").alias("value"))
    theirs = one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("theirs").alias("value"))
    shared = seen.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "none")).alias("at")).where(F.size("at") > 1)
    both = shared.select("lang", "at").mapInArrow(_both, "lang string, source string, item string, value long")
    pairs = reduce(DataFrame.unionByName, (least_value, mine, theirs, both)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by_pair = pairs.withColumn("rank", F.row_number().over(order))

    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(by_pair, "pair").unionByName(part(by_term, "term"))
