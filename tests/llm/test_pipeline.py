"""The pipeline's stages against plain versions of their decisions."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from panelweave.llm import secrets
from tests.llm.conftest import EDGE, SF
from tests.llm.test_similar import slow_kept
from tests.llm.test_text_operators import PIECES, WORDS, slow_contamination


@pytest.fixture(scope="module")
def edge_docs(spark, edge):
    rows = [(i, t, "en", "s", 5) for i, t in EDGE] + [(None, "far away from all else here", "en", "s", None), (3, "another text under a known id", "en", "s", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_each_stage_and_the_whole(spark, documents):
    docs = documents
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == documents.columns and 0 < out.count() <= docs.count()
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}
        if name == "simhash":
            assert {(False, i) for i in after} == slow_kept(before.items())
        if name == "decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert set(after) == {r[0] for r in slow_contamination(before.items(), items) if not r[-1]}
        if name == "secrets":
            assert set(after) == set(before) and any(after[i] != before[i] for i in before)
            left = [s for t in after.values() for s in secrets.find_secrets(t, secrets.ranks(WORDS)) if s[0] in ("access", "hex")]
            assert not left
            assert all(after[i] == before[i] for i in before if not secrets.find_secrets(before[i], secrets.ranks(WORDS)))
        docs = spark.createDataFrame(out.collect(), documents.schema)
    from sentencepiece import SentencePieceProcessor

    own = SentencePieceProcessor(model_file=PIECES)
    expected = {r.doc_id: own.encode(r.text) for r in docs.collect()}
    assert {r.doc_id: r.ids for r in cp.run(spark, SF).collect()} == expected


def test_stages_on_edges(spark, edge_docs):
    for _, stage in cp.STAGES:
        assert stage(spark, edge_docs.where("false"), SF).count() == 0
    assert cp.remove_toxic(spark, edge_docs, SF).count() == edge_docs.count()
    assert cp.encode(spark, edge_docs, SF).count() == edge_docs.count()
    assert rows(cp.remove_contaminated(spark, edge_docs, SF)) == rows(edge_docs)
    kept = [(r.doc_id, r.text) for r in cp.remove_near_duplicates(spark, edge_docs, SF).collect()]
    assert (None, "far away from all else here") in kept and (None, "lost id") in kept and (3, "another text under a known id") in kept
    assert sum(i == 3 for i, _ in kept) == 2 and len(kept) == len(set(kept)) and {i for i, t in kept if not t} == {1}
    wide = edge_docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(("scores", "_row", "_n", "my col", "text_key"))])
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns and out.count() == stage(spark, edge_docs, SF).count(), name
    masked = spark.createDataFrame([(1, "a token: abcdefghijkl9, b", "en", "s", 25), (2, None, "en", "s", None)], edge_docs.schema)
    assert rows(cp.mask_secrets(spark, masked, SF)) == sorted([(1, "a [SECRET], b", "en", "s", 13), (2, None, "en", "s", None)], key=repr)
