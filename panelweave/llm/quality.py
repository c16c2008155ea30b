"""Quality by hierarchical empirical Bayes.

A document classifier gives each text its evidence (log-odds against the labelled share). Sites are shrunk by grouped aggregation: a host's
share of good documents toward the global one, a path's toward its host's, with strengths estimated from how much sites differ
(method of moments). The site's share, with the document left out at every level, is the prior; the text's evidence is added.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import cut, record, skewed_join, slices, texts_of
from panelweave.llm.linear import fit_logistic, logit, sigmoid, training_set

KEEP = 0.5
#: A site's strength, in documents: least and most.
STRENGTH = (2.0, 1e6)


def _strength(groups: DataFrame, mean: str) -> float:
    """How many documents a group's prior share is worth: groups has n, s (sum of probabilities) and the share that it is shrunk toward."""
    m, n = F.col(mean), F.col("n")
    r = groups.where("n > 0").agg(
        F.count("*").alias("groups"), F.sum("n").alias("n"), F.sum(n * n).alias("nn"), F.sum(n * F.pow(F.col("s") / n - m, F.lit(2))).alias("spread"), F.avg(m * (1 - m)).alias("within")
    ).first()
    if not r["groups"] or r["groups"] < 2 or not r["within"]:
        return STRENGTH[1]
    between = (r["spread"] - (r["groups"] - 1) * r["within"]) / (r["n"] - r["nn"] / r["n"]) if r["n"] > r["nn"] / r["n"] else 0.0
    return float(np.clip(r["within"] / between - 1 if between > 0 else STRENGTH[1], *STRENGTH))


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def quality(docs: DataFrame, labels: DataFrame, good: Column | None = None, host_col: str = "source", path_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_text (classifier), p_host, p_path (shrunk site shares of the other documents), p_quality and keep (p_quality >= KEEP) of every row.

    A document alone at its path has its host's share as its prior, alone at its host the global one, alone in the table the labelled one. Null texts count as empty; rows without a host or path form a site of their own; repeated rows each count. Without labelled documents the
    classifier says one half for every text and all are kept. Equal texts get equal evidence, texts of any length count whole, further columns play no part.
    An empty table gives an empty result.
    """
    good = F.col("quality") == 1 if good is None else good
    sample = training_set(docs, labels, {"good": good}, id_col, text_col)
    (features, x), marks = sample.design(), sample.marks
    w = fit_logistic(x, marks[:, 0])
    share = float((marks.sum() + 0.5) / (len(marks) + 1))
    shared = docs.sparkSession.sparkContext.broadcast((features, w))
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("p_text", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, weights = shared.value
        for batch in slices(batches, "text"):
            p = sigmoid(own.of(texts_of(batch, "text")) @ weights[:-1] + weights[-1])
            yield record(schema, [*batch.columns[:3], pa.array(p)])

    text = lambda c, name: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(name)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text(host_col, "host"), text(path_col, "path"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = cut(rows.mapInArrow(run, "doc_id long, host string, path string, p_text double"))
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p_text").alias("s")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    overall = total["s"] / total["n"] if total["n"] else share
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).withColumn("m", F.lit(overall))
    k = _strength(hosts, "m")
    hosts = hosts.withColumn("p", (F.col("s") + k * F.col("m")) / (F.col("n") + k))
    paths = paths.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s"), "p"), "host")
    k_path = _strength(paths, "p")
    out = skewed_join(scored, cut(paths), ["host", "path"], "n", total["n"] or 0)
    within = lambda p: F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0))
    others = within((F.lit(total["s"]) - F.col("p_text")) / (total["n"] - 1)) if (total["n"] or 0) > 1 else F.lit(share)
    out = out.withColumn("p_host", within((F.col("host_s") - F.col("p_text") + k * others) / (F.col("host_n") - 1 + k)))
    out = out.withColumn("p_path", within((F.col("s") - F.col("p_text") + k_path * F.col("p_host")) / (F.col("n") - 1 + k_path)))
    p = 1 / (1 + F.exp(-(_logit(F.col("p_path")) + _logit(F.col("p_text")) - F.lit(float(logit(np.array(share)))))))
    out = out.withColumn("p_quality", p)
    return out.select("doc_id", "p_text", "p_host", "p_path", "p_quality", (F.col("p_quality") >= KEEP).alias("keep"))
