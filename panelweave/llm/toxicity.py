"""Toxicity by a classifier chain.

Categories are predicted one after the other; the model of a later category also sees the log-odds of each earlier one. It is trained with
the earlier ones' out-of-fold predictions (telling words and scales chosen without the fold, too), so it learns how far to trust predictions, not labels. The labelled table's columns are
the categories; here `quality` 0 (low_quality) comes before `toxic`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelweave.llm.common import free_name, numbered, slices
from panelweave.llm.linear import Features, fit_logistic, logit, sigmoid, training_set

#: A toxic probability from which a document is rejected; held-out clean texts stay far below it.
REJECT = 0.35


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    features: Features
    weights: tuple[np.ndarray, ...]

    def predict(self, texts: list[str]) -> np.ndarray:
        """Each category's probability, a column each."""
        x, out = self.features.of(texts), []
        for w in self.weights:
            p = sigmoid(x @ w[:-1] + w[-1])
            out.append(p)
            x = np.hstack([x, logit(p)[:, None]])
        return np.stack(out, axis=1)


def default_categories() -> dict[str, Column]:
    return {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}


def fit_chain(docs: DataFrame, labels: DataFrame, categories: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """The chain in the order of `categories` (name: boolean column of `labels`), fitted on a bounded sample of labelled documents.

    Without any labelled document, or where a category has one class only, its probability is that class's smoothed share (one half without rows).
    Labels or ids that are null, and documents without a text, take no part; of repeated rows of an id the least text and the highest label count;
    ties in the sample's order fall to the smaller id. Texts of any length count whole; further columns play no part.
    """
    categories = categories or default_categories()
    sample = training_set(docs, labels, categories, id_col, text_col)
    weights, earlier = [], np.zeros((len(sample.fold), 0))
    for k in range(len(categories)):
        features, x = sample.design(extra=earlier)
        weights.append(fit_logistic(x, sample.marks[:, k]))
        if k + 1 < len(categories):
            earlier = np.hstack([earlier, logit(sigmoid(sample.held_out(k, earlier)))[:, None]])
    return Chain(tuple(categories), features, tuple(weights))


def score(docs: DataFrame, chain: Chain, text_col: str = "text", out_col: str = "scores") -> DataFrame:
    """docs with out_col: a struct of the categories' probabilities for the whole text (null as empty).

    Rows, repeated ones too, and all columns stay; if one is named like the new one, that gets underscores. An empty table stays empty.
    """
    name, at = free_name(docs, out_col), docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # words of a bounded sample and a weight for each
    kind = pa.struct([(k, pa.float64()) for k in chain.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in slices(batches, f"c{at}"):
            p = own.predict([t or "" for t in batch.column(at).to_pylist()])
            scores = pa.StructArray.from_arrays([pa.array(p[:, i]) for i in range(p.shape[1])], fields=list(kind))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, name])

    return numbered(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(name, StructType([StructField(k, DoubleType()) for k in chain.names]))]))
