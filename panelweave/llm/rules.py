"""Quality rules as a short-circuit cascade.

A rule looks at one document and rejects it or not. What each rule costs and what it rejects is measured on a bounded sample of the documents;
the cascade then asks, at each place, the rule that rejects most of what the rules before it leave, for its cost. A document that one
rule rejects isn't shown to the next. The order sets the time only: a document is kept if no rule rejects it.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import id_and_text, record, slices, texts_of

#: Documents on which the rules are measured.
SAMPLE = 1000
WINDOW = 5
_SPACES, _SYMBOLS, _UPPER = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
_LETTERS = bytes(b for b in range(256) if 65 <= b <= 90 or 97 <= b <= 122 or b >= 128)


class Document:
    """A text and its counts, each computed when a rule first asks for it. Words are runs of anything but ASCII white space."""

    def __init__(self, text: str | None) -> None:
        self.text = text or ""
        self.raw = self.text.encode()

    def _count(self, chars: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, chars))

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()  # of bytes: at ASCII white space only

    @cached_property
    def ids(self) -> np.ndarray:
        """The words as numbers, equal where the words are."""
        known: dict[bytes, int] = {}
        return np.fromiter((known.setdefault(w, len(known)) for w in self.words), np.int64, len(self.words))

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - self._count(_SPACES)

    @cached_property
    def n_symbols(self) -> int:
        return self._count(_SYMBOLS)

    @cached_property
    def n_upper(self) -> int:
        return self._count(_UPPER)

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.raw.split(b"\n") if x.strip()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words inside windows of WINDOW words that the text has twice or more."""
        if self.n_words <= WINDOW:
            return 0
        own = self.ids
        rank = lambda a, b: np.unique(a * len(own) + b, return_inverse=True)[1]  # noqa: E731  ranks and ids are below the number of words
        two = rank(own[:-1], own[1:])
        four = rank(two[:-2], two[2:])
        five = rank(four[:-1], own[4:])
        again = np.bincount(five)[five] > 1
        edges = np.zeros(len(own) + 1, np.int64)
        edges[: len(again)] += again
        edges[WINDOW : WINDOW + len(again)] -= again
        return int((np.cumsum(edges)[:-1] > 0).sum())

    @cached_property
    def n_echoes(self) -> int:
        """Words equal to the word before them."""
        return int((self.ids[1:] == self.ids[:-1]).sum())

    @cached_property
    def n_lettered(self) -> int:
        """Words with a letter or a character beyond ASCII."""
        return sum(len(w.translate(None, _LETTERS)) < len(w) for w in self.words)


class Rule(NamedTuple):
    name: str
    rejects: Callable[[Document], bool]


class Measured(NamedTuple):
    rule: Rule
    seconds: float  # a document
    rejected: float  # share of the documents that the rules before it leave


BASE = (
    Rule("few_words", lambda d: d.n_words < 10),
    Rule("repeated_words", lambda d: 100 * d.n_repeat_words > 20 * d.n_words),
)
MORE = (
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("shouting", lambda d: 2 * d.n_upper > d.word_chars),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 16 * d.n_words),
    Rule("repeated_lines", lambda d: 2 * d.n_dup_lines > len(d.lines)),
    Rule("echoed_words", lambda d: 100 * d.n_echoes > 40 * d.n_words),
    Rule("few_letters", lambda d: 100 * d.n_lettered < 40 * d.n_words),
)


def _base(text: str | None) -> Document:
    """The document with the counts that are given out for every one."""
    d = Document(text)
    _ = (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words)
    return d


def measure(docs: DataFrame, rules: tuple[Rule, ...] = MORE, given: tuple[Rule, ...] = BASE, size: int = SAMPLE, text_col: str = "text") -> list[Measured]:
    """The rules in the order in which to ask them, measured on at most `size` documents that `given` don't reject.

    Texts stay in the tasks; the driver gets a row for each set of rules that reject some document together. An empty sample leaves the order.
    """
    names = [f"c{i}" for i in range(len(rules))]
    schema = pa.schema([("mask", pa.int64()), *[(c, pa.float64()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in texts_of(batch, "text"):
                if any(g.rejects(_base(text)) for g in given):
                    continue
                mask, spent = 0, []
                for i, rule in enumerate(rules):
                    d = _base(text)
                    began = time.perf_counter()
                    mask |= rule.rejects(d) << i
                    spent.append(time.perf_counter() - began)
                rows.append((mask, *spent))
            yield record(schema, [list(c) for c in zip(*rows, strict=True)] if rows else [[] for _ in schema])

    total = docs.count()
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    some = texts.sample(fraction=min(1.0, 2 * size / max(total, 1)), seed=42).limit(size)
    found = some.mapInArrow(run, ", ".join(["mask long", *[f"{c} double" for c in names]])).groupBy("mask").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()
    return in_order(rules, {r["mask"]: r["n"] for r in found}, [sum(r[c] for r in found) for c in names])


def in_order(rules: tuple[Rule, ...], masks: dict[int, int], seconds: list[float]) -> list[Measured]:
    """masks: how many documents exactly these rules reject (bit i: rule i); seconds: what each rule took for all of them."""
    n = sum(masks.values())
    left, out, rest = dict(masks), [], list(range(len(rules)))
    while rest:
        hit = {i: sum(c for m, c in left.items() if m >> i & 1) for i in rest}
        best = max(rest, key=lambda i: (hit[i] / max(seconds[i], 1e-9), -i))
        out.append(Measured(rules[best], seconds[best] / max(n, 1), hit[best] / max(sum(left.values()), 1)))
        rest.remove(best)
        left = {m: c for m, c in left.items() if not m >> best & 1}
    return out


def first_rejecting(document: Document, rules: list[Rule]) -> str | None:
    return next((r.name for r in rules if r.rejects(document)), None)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = MORE, size: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and rejected_by of every row.

    The base rules are asked first, as their counts are given out anyway; then the others, in the measured order. rejected_by is the rule that
    rejected a document first (null: kept); where several would, it depends on that order, kept does not. Null text has no words and
    is rejected; texts count whole; repeated rows each give a row; an empty table gives none; further columns aren't read.
    """
    ordered = [*BASE, *[m.rule for m in measure(docs, rules, size=size, text_col=text_col)]]
    base = {r.name for r in BASE}
    schema = pa.schema([
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()),
        ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("rejected_by", pa.string()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            rows = []
            for text in texts_of(batch, "text"):
                d = _base(text)
                by = first_rejecting(d, ordered)
                rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, by in base, by is None, by))
            yield record(schema, [batch.column(0), *[list(c) for c in zip(*rows, strict=True)]] if rows else [[] for _ in schema])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string")
