import pytest

SF = "/root/testdata/sf0.01"
EDGE = [
    (1, ""), (2, None), (3, "the cat sat on the mat"), (3, "the cat sat on the mat"), (4, "THE cat\tsat  on\nthe mat"), (5, "x"), (None, "lost id"), (6, "word " * 3000), (7, "z" * 5000),
    (8, "<|endoftext|> hello <|startoftext|>it's 42²"), (9, "naïve façade ŒUVRE ǅ İstanbul 中文 тест \U0001f600 é ▁▁ a▁b"), (10, "\x1c\x1d a\x85b\xa0c d"), (11, "a\x00b  c   d    "), (12, None),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, repeated rows, and further columns whose names clash with results."""
    rows = [(i, t, "n", 1, "s") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, fp int, spans string")


@pytest.fixture(scope="session")
def none(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text or "" for r in documents.select("doc_id", "text").collect()}
