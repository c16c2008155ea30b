import hashlib
from collections import Counter

import numpy as np
import pytest

from panelweave.llm import queries
from panelweave.llm.suffix_dedup import remove_repeats
from tests.llm.conftest import EDGE, SF


def slow(rows, n=200):
    raw = [(t or "").encode() for _, t in rows]
    seen = Counter(b[p : p + n] for b in raw for p in range(len(b) - n + 1))
    out = []
    for (i, _), b in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, dtype=np.int8)
        for p in range(len(b) - n + 1):
            if seen[b[p : p + n]] > 1:
                gone[p : p + n] = 1
        edges = np.diff(gone, prepend=0)
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(c for c, g in zip(b, gone, strict=False) if not g)).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(((r.doc_id, r.n_bytes, sum(s["end"] - s["start"] for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=repr)


def test_whole_table(spark, texts):
    assert sorted((tuple(r) for r in queries.op6_suffix_dedup(spark, SF).collect()), key=repr) == slow(list(texts.items()))


def test_sql_twins_agree_with_brute_force():
    """Spark's rows are held against the same brute force above and in test_text_operators."""
    import duckdb

    from tests.llm.test_text_operators import slow_contamination

    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    docs, items = c.sql("select doc_id, text from documents").fetchall(), c.sql("select item_id, text from benchmark").fetchall()
    twins = queries.oracle_sql()
    assert sorted(c.sql(twins["op6_suffix_dedup"]).fetchall(), key=repr) == slow(docs)
    assert sorted(c.sql(twins["op5_decontamination"]).fetchall(), key=repr) == sorted(slow_contamination(docs, items), key=repr)


@pytest.mark.parametrize("partitions", [1, 8, 97])
def test_edges_and_shared_passages(spark, edge, none, partitions):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    r = np.random.default_rng(9)
    word = lambda n: "".join(r.choice(list("abcdé \n"), n))
    shared = [word(k) for k in (150, 198, 199, 200, 201, 260, 700)]
    rows = [*EDGE, (30, "ab" * 400), (31, "q" * 199), (32, "q" * 200)]
    for i in range(60):
        parts = [word(int(r.integers(0, 300))) if r.random() < 0.6 else str(r.choice(shared)) for _ in range(6)]
        rows.append((100 + i, "".join(parts)))
    rows += [(900, rows[-1][1]), (901, rows[-2][1][:-3] + "x" + rows[-2][1][-3:])]
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, t1 int, core string")
    assert digest(remove_repeats(frame)) == slow(rows)
    assert remove_repeats(none).count() == 0
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_one_line_in_many_contexts(spark):
    """A passage a little longer than a window, with different words on both sides, so that its windows meet only by name."""
    r = np.random.default_rng(4)
    word = lambda n: "".join(r.choice(list("abcdefgh "), n))
    line = word(215)
    rows = [(i, word(int(r.integers(0, 150))) + line[: len(line) - i % 3] + word(int(r.integers(0, 150)))) for i in range(400)] + [(i, line) for i in range(400, 410)]
    rows += [(500 + i, line[i:] + word(60)) for i in range(12)]
    assert digest(remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == slow(rows)
