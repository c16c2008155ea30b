"""Secrets: fixed token shapes, and credential values that a guesser could not reach cheaply.

A value in a credential context (`pwd is ...`, `login: ...`) is cut into dictionary words, dates, repeats, sequences, keyboard walks and
brute-force spans so that the total guess cost (bits) is least; values of at least `GUESS_BITS` are secrets. A repeat costs what its unit costs, itself cut in
the cheapest way (in lower case), and its count. A value begins with eight visible characters of any script: no shorter one costs that much. A value that a base shape finds only in part is a secret as a whole, whatever its cost. Dictionary words are all whole-word entries of
a public vocabulary; their ranks are its merge order, which follows frequency only roughly.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from panelweave.llm.common import numbered, slices
from panelweave.llm.spans import Span, add_spans

KINDS = ("assign", "access", "hex", "guess")
GUESS_BITS = 40.0
#: The base shapes.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a run of fewer fails wherever in it one starts
HEX = re.compile(r"[0-9a-f]{16,}")
#: Neither a control character nor a space of any script.
_VISIBLE = r"[^\x00-\x20\x7f-\xa0\u1680\u2000-\u200f\u2028-\u202f\u205f\u3000]"
CONTEXT = re.compile(rf"(?<![a-z0-9])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|credentials?|login|auth|pin)[\"']?[\x20\t]*+(?:=>|:=|[:=]|\bis\b)[\x20\t]*+[\"']?(?=({_VISIBLE}){_VISIBLE}{{7}})", re.I | re.A)

_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?\d\d[-/.]?\d\d)?|\d\d[-/.]?\d\d[-/.]?(?:19|20)\d\d|\d\d[-/.]\d\d[-/.]\d\d", re.A)
_ROWS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("4@3105$7!", "aaelossti")
_RUN = re.compile(f"{_VISIBLE}*")
#: Costs from here on aren't told apart. What costs less is made of segments that begin at places that cost less, so a value without such a place within
#: reach, and without a repeat that goes on, is given up.
MOST_BITS = 64.0
#: A walk of more characters costs more than MOST_BITS.
_WALK = int(MOST_BITS / 1.5) + 2
_NEAR = {(a, b) for row in _ROWS for a, b in zip(row, row[1:], strict=False)} | {(row[i], below[j]) for row, below in zip(_ROWS, _ROWS[1:], strict=False) for i in range(len(row)) for j in (i - 1, i) if 0 <= j < len(below)}
_NEAR |= {(b, a) for a, b in _NEAR}
class Ranks(dict):
    """Rank by word."""

    def __init__(self, words: Iterable[str]) -> None:
        super().__init__((w, i) for i, w in enumerate(words, 1))
        self.longest = max(map(len, self), default=0)


_ranks: dict[str, Ranks] = {}


def ranks(vocabulary_path: str) -> Ranks:
    """Rank (from 1) of each whole word of three letters or more."""
    if vocabulary_path not in _ranks:
        with open(vocabulary_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        words = (w[: -len("</w>")] for w, _ in sorted(vocabulary.items(), key=lambda x: x[1]) if w.endswith("</w>"))
        _ranks[vocabulary_path] = Ranks(w for w in words if len(w) >= 3 and w.isascii() and w.isalpha())
    return _ranks[vocabulary_path]


def _brute(c: str) -> float:
    return log2(10 if c.isdigit() else 26 if c.isalpha() else 33)


def _upper_bits(own: str) -> float:
    """What the spelling in capitals adds to a word."""
    if own == own.lower():
        return 0.0
    return 1.0 if own.isupper() or own[0].isupper() and own[1:] == own[1:].lower() else float(len(own))


def _kept(starts: list[tuple[int, float]], end: int, unit: int = 1) -> tuple[list[tuple[int, float]], float]:
    """Of (start, cost before it), by start, those that may still be the cheapest for a run that goes on, and the least cost at `end`: a later start that isn't cheaper than
    an earlier one never will be, as the difference of their counts' logarithms only falls."""
    kept, least = [], float("inf")
    for start, before in starts:
        cost = before + log2((end - start) // unit)
        if cost < least:
            kept.append((start, before))
            least = cost
    return kept, least


def guess_bits(value: str, rank: Ranks) -> float:
    """log2 of the guesses for the cheapest segmentation of the value, MOST_BITS at most; a segment costs one bit besides its own."""
    return _least(value, rank, {})


def _least(value: str, rank: Ranks, known: dict[str, float]) -> float:
    """known: units of repeats whose cost has been found."""
    low = value.lower()
    low = low if len(low) == len(value) else value  # the few characters whose small form is longer
    plain = low.translate(_LEET)
    n = len(value)
    best = [0.0] + [float("inf")] * n
    brute = [_brute(c) for c in low]
    ends_brute = [0.0] + [float("inf")] * n  # the cheapest segmentation whose last segment is brute force
    same = walk = step = alive = 0  # where the current run of one character, keyboard walk, sequence began; the last place that costs less than MOST_BITS
    reach = max(rank.longest, _WALK)
    codes = np.frombuffer(low.encode("utf-32-le"), np.uint32)
    half = n // 2
    sames: list[tuple[int, float]] = []  # where parts of the current run of one character may begin
    steps: list[tuple[int, float]] = []  # and of the current sequence
    repeats: dict[int, tuple[int, dict[int, tuple[int, list[tuple[int, float]]]]]] = {}  # by unit: where its run began, and by phase the next start and those kept
    units = np.arange(1, half + 1)
    again = np.zeros(half, np.int64)  # by unit: characters in a row that equal the one a unit before
    for end in range(1, n + 1):
        c = low[end - 1]
        ends_brute[end] = min(best[end - 1] + 1, ends_brute[end - 1] if end > 1 else float("inf")) + brute[end - 1]
        cost = ends_brute[end]
        for start in range(max(0, end - rank.longest), end - 2):
            for text, extra in ((low[start:end], 0.0), (plain[start:end], 2.0)):
                if text in rank:
                    cost = min(cost, best[start] + 1 + log2(rank[text] + 1) + extra + _upper_bits(value[start:end]))
                    break
        for size in (4, 6, 8, 10):
            if end >= size and value[end - 1].isdigit() and _DATE.fullmatch(value, end - size, end):
                cost = min(cost, best[end - size] + 1 + (log2(200) if size == 4 else log2(366 * 200)))
        if end > 1:
            before = low[end - 2]
            if c != before:
                same, sames = end - 1, []
            if (before, c) not in _NEAR and c != before:
                walk = end - 1
            if ord(c) - ord(before) != 1:
                step, steps = end - 1, []
            if end - 3 >= same:
                sames, least = _kept([*sames, (end - 3, best[end - 3])], end)
                cost = min(cost, least + 1 + brute[end - 1])
            for start in range(max(walk, end - _WALK), end - 3):
                cost = min(cost, best[start] + 1 + log2(47) + 1.5 * (end - start - 1))
            if end - 3 >= step:
                steps, least = _kept([*steps, (end - 3, best[end - 3])], end)
                cost = min(cost, least + 1 + log2(36))
            m = min(half, end - 1)
            now = again[:m]
            now += 1
            now[codes[end - 1 - m : end - 1][::-1] != codes[end - 1]] = 0
            for unit in _squares(now, units[:m], reach):  # two or more of what stands before
                begin, last = end - unit - int(now[unit - 1]), end - 2 * unit
                if unit not in repeats or repeats[unit][0] != begin:
                    repeats[unit] = begin, {}
                phases = repeats[unit][1]
                at, starts = phases.get(end % unit, (last - (last - begin) // unit * unit, []))
                starts, least = _kept(starts + [(s, best[s]) for s in range(at, last + 1, unit) if best[s] < MOST_BITS], end, unit)
                phases[end % unit] = last + unit, starts
                if starts:
                    own = low[end - unit : end]
                    if own not in known:
                        known[own] = _least(own, rank, known)
                    cost = min(cost, least + 1 + known[own])
            if cost >= MOST_BITS and end - alive > reach and min(same, step) > alive and now.max() < end - alive:
                return MOST_BITS
        best[end] = cost
        if cost < MOST_BITS:
            alive = end
    return min(best[n], MOST_BITS)


def _squares(again: np.ndarray, units: np.ndarray, reach: int) -> list[int]:
    """Units of two characters or more that stand twice in a row; of those that are repeats themselves only such as a word or a date may be."""
    found = units[again >= units]
    if len(found) and len(found) > (found[0] == 1):
        first = int(found[0])
        inner = (found > first) & (found % first == 0) & (again[first - 1] >= found - first) & (found > reach)
        found = found[~inner]
    return [u for u in found.tolist() if u > 1]


def _stop(text: str, start: int, end: int) -> int:
    """Where the value that begins at start and runs to end at most stops: at the quote it was opened with, else before closing punctuation."""
    quote = text[start - 1]
    if quote in "\"'":
        at = text.find(quote, start, end)
        while at > start and text[at - 1] == "\\":
            at = text.find(quote, at + 1, end)
        if at >= 0:
            return at
    return start + len(text[start:end].rstrip("\"',;.:)]}"))


class _Runs:
    """Where the run of visible characters around a place ends; a run is measured once."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, 0, 0

    def end_of(self, at: int) -> int:
        if not self.start <= at < self.end:
            self.start, self.end = at, _RUN.match(self.text, at).end()
        return self.end


def _values(text: str) -> list[tuple[int, int]]:
    """Start and end of each value in a credential context, in order; what follows a closing quote is searched again."""
    found, at, runs = [], 0, _Runs(text)
    while m := CONTEXT.search(text, at):
        at = _stop(text, m.start(1), runs.end_of(m.start(1)))
        found.append((m.start(1), at))
        at = max(at, m.start(1) + 1)
    return found


def _holding(spans: list[list[int]], start: int, end: int) -> list[list[int]]:
    """Those of disjoint sorted spans that overlap start..end."""
    at = bisect_right(spans, start, key=lambda x: x[1])
    return spans[at : bisect_left(spans, end, lo=at, key=lambda x: x[0])]


def find_secrets(text: str, rank: Ranks) -> list[Span]:
    assigned = [m for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found: list[Span] = [("assign", *m.span(), 1.0) for m in assigned]
    found += [("access", *m.span(), 1.0) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span(), 1.0) for m in HEX.finditer(text)]
    taken = _merged([(s, e) for _, s, e, _ in found])
    values, runs = _values(text), _Runs(text)
    seen = _merged(values)
    for m in assigned:  # also after words that open no context, such as dbpassword
        if not _holding(seen, m.start(2), m.start(2) + 1):
            values.append((m.start(2), _stop(text, m.start(2), runs.end_of(m.start(2)))))
    for start, end in sorted(values):
        if end - start >= 8:
            known = _holding(taken, start, end)
            if not any(s <= start and end <= e for s, e in known) and ((bits := guess_bits(text[start:end], rank)) >= GUESS_BITS or known):
                found.append(("guess", start, end, bits))
    return found


def secret_spans(docs: DataFrame, vocabulary_path: str, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """docs with the secrets of each whole text: array of (kind, start, end, score), positions in code points, end exclusive.

    Kinds: assign, access, hex (score 1), guess (score: bits; a value that reaches beyond one of the others overlaps it). Null and empty texts give an empty array; texts of any
    length count whole; repeated rows each get theirs, an empty table stays empty. Where values tie, each is a span of its own. Rows, their order within a partition and all
    other columns stay as they are; a column that is named like the new one stays too, and the new one gets underscores.
    """
    return add_spans(docs, lambda text: find_secrets(text, ranks(vocabulary_path)), text_col, out_col)


def _merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    """Each maximal run of overlapping spans as one."""
    merged: list[list[int]] = []
    for s, e in sorted(spans):
        if merged and s < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    return merged


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping spans replaced by the mark."""
    out, at = [], 0
    for s, e in _merged(spans):
        out += [text[at:s], mark]
        at = e
    return "".join([*out, text[at:]])


def mask_secrets(docs: DataFrame, vocabulary_path: str, text_col: str = "text", length_col: str | None = None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in the text replaced by the mark, in one pass; length_col, if given, follows the texts that change.

    Rows without a secret, null and empty texts stay exactly as they are, and so do all other columns whatever their names; repeated rows are masked alike, texts of any length as
    a whole, an empty table stays empty.
    """
    at, n = docs.columns.index(text_col), docs.columns.index(length_col) if length_col else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank = ranks(vocabulary_path)
        for batch in slices(batches, f"c{at}"):
            texts = batch.column(at).to_pylist()
            found = [find_secrets(t, rank) if t else [] for t in texts]
            masked = [redact(t, [(s, e) for _, s, e, _ in x], mark) if x else t for t, x in zip(texts, found, strict=True)]
            columns = batch.columns
            columns[at] = pa.array(masked, columns[at].type)
            if n is not None:
                columns[n] = pa.array([len(t) if x else old for t, x, old in zip(masked, found, columns[n].to_pylist(), strict=True)], columns[n].type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return numbered(docs).mapInArrow(run, docs.schema)
