"""A corpus pipeline: toxic documents go, near duplicates go but for one of each family, contaminated documents go, secrets are masked, and
what stays is encoded.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs. A row is
named by its id and the XXH64 of its text; rows that agree in both are interchangeable in every decision. Columns besides doc_id and
text pass through; an empty table gives an empty result at every stage, and texts count whole, null as empty.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelweave.llm import secrets, toxicity as tox
from panelweave.llm.common import bounded_batches, free_name, shared_folder, table
from panelweave.llm.decontaminate import decontaminate
from panelweave.llm.sentencepiece_codec import encode_decode
from panelweave.llm.similar import similar_families

#: No SQL twin: fingerprints, models and token tables are beyond SQL.
ORACLE_SQL = None


def _text_key() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; repeated rows are judged alike, null as empty."""
    name = free_name(docs, "scores")
    scored = tox.score(docs, tox.fit_chain(docs, table(bounded_batches(spark), sf_dir, "labels")), out_col=name)
    return scored.where(F.col(name)["toxic"] < tox.REJECT).drop(name)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each family of texts that SimHash and 5-word Jaccard similarities of 0.8 or more connect the document with the smallest id stays.

    Ties between texts of one id fall to the smaller text key; of repeated rows one stays, the first by its other columns. Wordless
    texts, null and empty ones among them, are one family.
    """
    bounded_batches(spark)
    place = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id")  # rows without an id come last
    of_text = docs.groupBy(_text_key().alias("text_key")).agg(F.min(place).alias("place"))
    of_family = of_text.join(similar_families(docs), "text_key").groupBy("root").agg(F.min(F.struct("place", "text_key")).alias("first"))
    row, key = (free_name(docs, c) for c in ("_row", "_key"))
    kept = of_family.select(F.col("first.place.doc_id").alias("_kept_id"), F.col("first.text_key").alias("_kept_key")).withColumn("_kept_row", F.xxhash64("_kept_id", "_kept_key"))
    named = docs.withColumn(key, _text_key()).withColumn(row, F.xxhash64("doc_id", key))
    same = (F.col(row) == F.col("_kept_row")) & F.col("doc_id").eqNullSafe(F.col("_kept_id")) & (F.col(key) == F.col("_kept_key"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy(row, "doc_id", key).orderBy(*others or [F.lit(0)])
    n = free_name(docs, "_n")
    return named.join(kept, same, "left_semi").withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(row, key, n)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark window occurs go; repeated rows go together."""
    hit = decontaminate(docs, table(bounded_batches(spark), sf_dir, "benchmark")).where("n_hit > 0").select(F.col("doc_id").alias("_hit_id"), F.col("text_key").alias("_hit_key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_hit_id")) & (F.xxhash64("text") == F.col("_hit_key"))
    return docs.join(hit, same, "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; each secret in its text becomes a mark, and n_chars, if there, follows."""
    bounded_batches(spark)
    return secrets.mask_secrets(docs, public_tokenizers.path("word_bpe_49k.json"), length_col="n_chars" if "n_chars" in docs.columns else None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and decoded_key (XXH64 of the decoded text) of every document that is left; a null text has no ids."""
    bounded_batches(spark)
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.xxhash64("decoded").alias("decoded_key"))


STAGES = [
    ("toxicity", remove_toxic),
    ("simhash", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("secrets", mask_secrets),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the whole documents table. A stage's folder is the next one's input and stays in the shared folder."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
