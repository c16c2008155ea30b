"""The registered queries of this subpackage: thin forms of its operators over the given tables."""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm import oracle, pii, secrets, toxicity
from panelweave.llm.common import bounded_batches, table
from panelweave.llm.decontaminate import decontaminate
from panelweave.llm.divergence import divergences
from panelweave.llm.neighbours import nearest
from panelweave.llm.quality import quality
from panelweave.llm.rules import quality_rules
from panelweave.llm.sentencepiece_codec import encode_decode
from panelweave.llm.simhash import near_duplicates
from panelweave.llm.spans import counted, listed
from panelweave.llm.suffix_dedup import remove_repeats
from panelweave.llm.token_counts import token_counts
from panelweave.llm.whitening import whiten


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.secret_spans(docs, public_tokenizers.path("word_bpe_49k.json"))
    base = secrets.KINDS[:3]
    return found.select("doc_id", *[counted(k).alias(f"n_{k}") for k in base], F.sha2(listed(base, True), 256).alias("base_sha256"), listed(secrets.KINDS, True).alias("spans"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = pii.KINDS[:4]
    return found.select("doc_id", *[counted(k).alias(f"n_{k}") for k in base], F.sha2(listed(base, False), 256).alias("base_sha256"), listed(pii.KINDS, False).alias("spans"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit_chain(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.col("scores.low_quality").alias("p_low_quality"), F.col("scores.toxic").alias("p_toxic"), (F.col("scores.toxic") >= toxicity.REJECT).alias("toxic"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(table(spark, sf_dir, "documents"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("rejected_by")


def _bounded(query):  # noqa: ANN001, ANN202
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(bounded_batches(spark), sf_dir)

    return run


def queries() -> dict:
    made = (op1_token_counts, op2_simhash, op3_quality, op4_secrets, op5_decontamination, op6_suffix_dedup, op7_pii, op8_toxicity, op9_neighbours, op10_sentencepiece, op11_divergence, op12_whitening, op13_quality_rules)
    return {f.__name__: _bounded(f) for f in made}


def oracle_sql() -> dict[str, str]:
    """The others need a tokenizer's tables, XXH64, fitted models or the added spans; the tests hold them against brute force."""
    return {"op5_decontamination": oracle.DECONTAMINATION, "op6_suffix_dedup": oracle.SUFFIX_DEDUP, "op11_divergence": oracle.DIVERGENCES, "op13_quality_rules": oracle.QUALITY_RULES}
