"""Small logistic models of documents: style figures and the presence of telling words.

A model is fitted on a bounded sample of labelled rows (`MAX_LABELLED`, chosen by hash of the id). Telling words are found by a grouped count over
that sample, all that pass the test; figures are standardised. For out-of-fold predictions both are done once more without each fold, so nothing
of a fold's labels reaches the model that predicts it. Scoring runs over whole texts on the executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import cut, id_and_text, record, slices, texts_of
from panelweave.llm.decontaminate import words_of

MAX_LABELLED = 8_000
FOLDS = 4
#: A word is telling from this chi-square on (one degree of freedom: by chance in fewer than one of 10^6 words), in this many labelled texts.
LEAST_CHI2, LEAST_TEXTS = 25.0, 5
STYLE = ("upper", "digit", "symbol", "newline", "beyond_ascii", "log_bytes", "word_bytes", "new_words", "repeated_lines", "top_byte")


def style(text: str, words: list[bytes], distinct: int) -> list[float]:
    raw = np.frombuffer(text.encode(), np.uint8)
    if not len(raw):
        return [0.0] * len(STYLE)
    n = np.bincount(raw, minlength=256) / len(raw)
    lines = [x for x in text.split("\n") if x.strip()]
    plain = n[48:58].sum() + n[65:91].sum() + n[97:123].sum() + n[128:].sum() + n[[9, 10, 13, 32, 39, 44, 45, 46, 63]].sum()
    return [n[65:91].sum(), n[48:58].sum(), 1 - plain, n[10], n[128:].sum(), np.log1p(len(raw)), len(raw) / (len(words) + 1), distinct / (len(words) + 1), 1 - len(set(lines)) / max(1, len(lines)), n[33:].max()]


def labelled(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text and a 0/1 column for each category: at most MAX_LABELLED documents with all labels; one row for each id.

    A null label or text leaves the document out; of repeated rows of an id the smallest text and the largest marks count; an empty table gives none. Texts stay whole; further columns aren't read.
    """
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), *[c.cast("int").alias(k) for k, c in categories.items()])
    marks = marks.dropna().groupBy("doc_id").agg(*[F.max(k).alias(k) for k in categories])
    sample = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)
    rows = id_and_text(docs, id_col, text_col).dropna().join(F.broadcast(sample), "doc_id")  # MAX_LABELLED rows of integers
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), *[F.max(k).alias(k) for k in categories])


def telling_words(rows: DataFrame, categories: list[str]) -> tuple[list[bytes], np.ndarray]:
    """Words whose presence goes with a category, by chi-square: the words, and a column for each fold left out and, last, for none: where each is telling.

    rows: text, fold and the categories.
    """
    kept = ("texts", *categories)
    schema = pa.schema([("word", pa.binary()), ("fold", pa.int32()), *((k, pa.int64()) for k in kept)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 16 << 20):
            seen: dict[tuple[bytes, int], np.ndarray] = {}
            marks = np.array([[1, *m] for m in zip(*(batch.column(i).to_pylist() for i in range(2, len(categories) + 2)), strict=True)])
            for text, fold, mark in zip(texts_of(batch, "text"), batch.column(1).to_pylist(), marks, strict=True):
                for w in set(words_of(text)):
                    seen[w, fold] = seen[w, fold] + mark if (w, fold) in seen else mark
            columns = [[w for w, _ in seen], [f for _, f in seen], *(list(c) for c in zip(*(v.tolist() for v in seen.values()), strict=True))]
            yield record(schema, columns if seen else [[]] * len(schema))

    totals = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("texts"), *[F.sum(k).alias(k) for k in categories]).collect()}
    if not totals:
        return [], np.zeros((0, FOLDS + 1), bool)
    counts = rows.select("text", "fold", *categories).mapInArrow(count, "word binary, fold int, " + ", ".join(f"{k} long" for k in kept))
    without = [*range(FOLDS), None]
    sums = [F.sum(F.when(F.col("fold") != f, F.col(c)).otherwise(0) if f is not None else F.col(c)).cast("double").alias(f"{c}_{i}") for i, f in enumerate(without) for c in kept]
    counts = counts.groupBy("word").agg(*sums).where(F.col(f"texts_{FOLDS}") >= LEAST_TEXTS)

    def telling(i: int, f: int | None) -> Column:
        whole = {c: float(sum(r[c] for g, r in totals.items() if g != f)) for c in kept}
        n, t, chi2 = F.lit(whole["texts"]), F.col(f"texts_{i}"), []
        for k in categories:
            p, a = F.lit(whole[k]), F.col(f"{k}_{i}")
            chi2.append(F.coalesce(F.try_divide(n * F.pow(a * n - t * p, F.lit(2)), t * (n - t) * p * (n - p)), F.lit(0.0)))
        return (t >= LEAST_TEXTS) & (F.greatest(F.lit(0.0), *chi2) >= LEAST_CHI2)

    marked = counts.select("word", *[telling(i, f).alias(f"in_{i}") for i, f in enumerate(without)])
    found = marked.where(" or ".join(f"in_{i}" for i in range(FOLDS + 1))).orderBy("word").collect()  # words of a bounded sample
    return [bytes(r["word"]) for r in found], np.array([[r[f"in_{i}"] for i in range(FOLDS + 1)] for r in found], dtype=bool).reshape(len(found), FOLDS + 1)


@dataclass(frozen=True)
class Features:
    """Style figures, standardised, and the presence of each telling word."""

    words: dict[bytes, int]
    mean: np.ndarray
    spread: np.ndarray

    def of(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), len(STYLE) + len(self.words)))
        for row, text in zip(out, texts, strict=True):
            words = words_of(text)
            distinct = set(words)
            row[: len(STYLE)] = style(text, words, len(distinct))
            row[[len(STYLE) + self.words[w] for w in distinct if w in self.words]] = 1
        out[:, : len(STYLE)] = (out[:, : len(STYLE)] - self.mean) / self.spread
        return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def log_odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x: rows of features, in single precision too; w: weights, the intercept last."""
    return (x @ w[:-1].astype(x.dtype)).astype(np.float64) + w[-1]


def fit_logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights, the intercept last, with an L2 penalty on all but the intercept: Newton steps, each solved by conjugate gradients."""
    w = np.zeros(x.shape[1] + 1)
    w[-1] = logit(np.array((y.sum() + 0.5) / (len(y) + 1)))
    if len(set(y.tolist())) < 2:
        return w
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-9

    def back(v: np.ndarray) -> np.ndarray:
        return np.append((v.astype(x.dtype) @ x).astype(np.float64), v.sum())

    def loss(w: np.ndarray) -> float:
        z = log_odds(x, w)
        return float(np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * w * w).sum())

    def squared(v: np.ndarray) -> np.ndarray:
        return np.append(sum((v[i : i + 512].astype(x.dtype) @ (x[i : i + 512] * x[i : i + 512]) for i in range(0, len(x), 512)), np.zeros(x.shape[1])), v.sum())

    now = loss(w)
    for _ in range(40):
        p = sigmoid(log_odds(x, w))
        grad, curve = back(p - y) + ridge * w, p * (1 - p)
        scale = squared(curve) + ridge + 1e-9
        step, rest = np.zeros(len(w)), grad.copy()
        way = rest / scale
        left = rest @ way
        goal = 1e-6 * left
        for _ in range(60):
            if left <= goal:
                break
            bent = back(curve * log_odds(x, way)) + ridge * way
            size = left / (way @ bent)
            step += size * way
            rest -= size * bent
            before, left = left, rest @ (rest / scale)
            way = rest / scale + left / before * way
        size = 1.0
        while size > 1e-4 and (after := loss(w - size * step)) > now:
            size /= 2
        if size <= 1e-4:
            break
        w, now = w - size * step, after
        if np.abs(size * step).max() < 1e-4:
            break
    return w


@dataclass(frozen=True)
class Sample:
    """The bounded sample: each row's fold, labels (a column for each category), style figures and telling words."""

    fold: np.ndarray
    marks: np.ndarray
    style: np.ndarray
    present: list[np.ndarray]
    words: list[bytes]
    told: np.ndarray

    def design(self, without: int | None = None, extra: np.ndarray | None = None) -> tuple[Features, np.ndarray]:
        """Words and standardisation from all folds but one (from all), and all rows in these terms; extra: further columns, the last ones."""
        at = np.flatnonzero(self.told[:, FOLDS if without is None else without])
        own = self.style[self.fold != without] if without is not None else self.style
        mean, spread = (own.mean(axis=0), own.std(axis=0)) if len(own) else (np.zeros(len(STYLE)), np.ones(len(STYLE)))
        spread = np.where(spread > 1e-9, spread, 1.0)
        column = np.full(len(self.words), -1)
        column[at] = np.arange(len(at))
        more = 0 if extra is None else extra.shape[1]
        x = np.zeros((len(self.style), len(STYLE) + len(at) + more), np.float32)
        x[:, : len(STYLE)] = (self.style - mean) / spread
        for row, present in zip(x, self.present, strict=True):
            here = column[present]
            row[len(STYLE) + here[here >= 0]] = 1
        if more:
            x[:, -more:] = extra
        return Features({self.words[i]: j for j, i in enumerate(at.tolist())}, mean, spread), x

    def held_out(self, category: int, extra: np.ndarray) -> np.ndarray:
        """Log-odds of a category by models that saw neither the row nor its fold; extra: further columns."""
        out = np.zeros(len(self.fold))
        for f in range(FOLDS):
            x = self.design(f, extra)[1]
            w = fit_logistic(x[self.fold != f], self.marks[self.fold != f, category])
            out[self.fold == f] = log_odds(x[self.fold == f], w)
        return out


def training_set(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> Sample:
    """At most MAX_LABELLED labelled documents, in an order that their ids give; rows as in `labelled`. Without any the sample is empty, and fits of it say one half."""
    names = list(categories)
    rows = labelled(docs, labels, categories, id_col, text_col).withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int"))
    rows = cut(rows)
    words, told = telling_words(rows, names)
    raw = Features({w: i for i, w in enumerate(words)}, np.zeros(len(STYLE)), np.ones(len(STYLE)))
    schema = pa.schema([("spot", pa.int64()), ("fold", pa.int32()), ("marks", pa.list_(pa.int32())), ("style", pa.list_(pa.float64())), ("present", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = raw.of(texts_of(batch, "text"))
            marks = [list(m) for m in zip(*(batch.column(3 + i).to_pylist() for i in range(len(names))), strict=True)]
            yield record(schema, [batch.column(0), batch.column(1), marks, x[:, : len(STYLE)].tolist(), [np.flatnonzero(r[len(STYLE) :]).tolist() for r in x]])

    made = rows.select(F.xxhash64("doc_id").alias("spot"), "fold", "text", *names).mapInArrow(run, "spot long, fold int, marks array<int>, style array<double>, present array<int>").toPandas().sort_values("spot")
    return Sample(
        made["fold"].to_numpy(dtype=np.int64), np.array(made["marks"].tolist(), dtype=float).reshape(len(made), len(names)), np.array(made["style"].tolist(), dtype=float).reshape(len(made), len(STYLE)),
        [np.array(p, dtype=int) for p in made["present"]], words, told,
    )
