"""Stripes and divergences against a plain dense version."""

import re
from collections import Counter, defaultdict
from itertools import product

import pytest

from panelweave.llm import divergence
from panelweave.llm.divergence import divergences

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def plain(rows, least=3, top=200):
    rows = [(a or "", b or "", TERM.findall((t or "").translate(FOLD))) for a, b, t in rows]
    out = []
    for lang in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == lang]
        df = Counter(w for _, _, ws in own for w in set(ws))
        kept = sorted(w for w, n in df.items() if n >= least)
        count = defaultdict(Counter)
        for _, source, ws in own:
            count[source].update(w for w in ws if df[w] >= least)
        total = sum(count.values(), Counter())
        p = lambda c, w, v=len(kept): 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + v)
        f = lambda a, b: (a - b) ** 2 // b
        for a in count:
            pairs = [(b, sum(f(p(count[a], w), p(count[b], w)) for w in kept)) for b in count if b != a]
            terms = [(w, f(p(count[a], w), p(total, w))) for w in kept if count[a][w] and p(count[a], w) > p(total, w)]
            for part, found in (("pair", pairs), ("term", terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, a, part, item, value, k + 1) for k, (item, value) in enumerate(ranked) if part == "pair" or k < top]
    return sorted(out)


def got(df):
    return sorted((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


ROWS = [
    ("en", "a", "the cat sat"), ("en", "a", "the cat sat"), ("en", "b", "the CAT ran; café É"), ("en", "b", "the dog, the dog 42 the_dog"), ("en", None, None), ("en", None, "café the"), ("en", "", "café"), ("en", "quiet", ""),
    (None, "a", "x x x"), (None, "a", "x y"), ("", "b", "x y"), ("de", "a", "nur einmal"), ("de", "b", "nur zweimal"), ("fr", "alone", "le le le"), ("fr", "alone", "le la"), ("fr", "alone", "le la \x00la"),
]


def test_equals_the_dense_sums(spark):
    df = spark.createDataFrame([(*r, 1, "n") for r in ROWS], "lang string, source string, text string, value int, rank string")
    assert got(divergences(df)) == plain(ROWS)
    assert got(divergences(df, least=1, top=2)) == plain(ROWS, 1, 2)
    assert divergences(df.where("false")).count() == 0
    words = [f"{a}{b}" for a, b in product("abcdefgß", "hijklm")]
    many = [(f"l{i % 3}", f"s{i * i % 7}", " ".join(words[(i * k * k + k) % len(words)] for k in range(i % 40))) for i in range(400)]
    assert got(divergences(spark.createDataFrame(many, "lang string, source string, text string"))) == plain(many)


@pytest.mark.parametrize(("entries", "rows"), [(1, 1), (7, 2), (40, 1000)])
def test_spilled_stripes_meet_again(monkeypatch, entries, rows):
    import pyarrow as pa

    monkeypatch.setattr(divergence, "MAX_ENTRIES", entries)
    monkeypatch.setattr(divergence, "_ROWS_OUT", rows)
    docs = [(a or "", b or "", (t or "").encode()) for a, b, t in ROWS * 3]
    batches = [pa.RecordBatch.from_arrays([pa.array([d[k] for d in docs[i : i + 5]], pa.binary() if k == 2 else pa.string()) for k in range(3)], names=["lang", "source", "text"]) for i in range(0, len(docs), 5)]
    partial = [r for b in divergence._folded(iter(batches)) for r in b.to_pylist()]
    partial.sort(key=lambda r: (r["term"], r["lang"]))
    again = [pa.RecordBatch.from_pylist(partial[i : i + 3], schema=divergence._PARTIAL) for i in range(0, len(partial), 3)]
    got = [r for b in divergence._merged(3)(iter(again)) for r in b.to_pylist()]
    want = {}
    for lang, source, text in docs:
        for term in set(divergence.terms_of(text)):
            df, counts = want.setdefault((lang, term.decode()), [0, Counter()])
            want[lang, term.decode()][0] = df + 1
            counts[source] += divergence.terms_of(text).count(term)
    assert len({(r["lang"], r["term"]) for r in got}) == len(got)
    assert {(r["lang"], r["term"]): [r["df"], dict(zip(r["sources"], r["counts"], strict=True))] for r in got} == {k: [n, dict(c)] for k, (n, c) in want.items() if n >= 3}


def test_a_very_long_text_and_a_hot_source(spark):
    rows = [("en", "hot", "common " * 50_000 + " ".join(f"w{chr(97 + i % 26)}" for i in range(1000)))] + [("en", "hot" if i % 3 else f"s{i}", f"common w{chr(97 + i % 26)}") for i in range(120)]
    assert got(divergences(spark.createDataFrame(rows, "lang string, source string, text string"))) == plain(rows)


def test_pairs_in_small_blocks(spark, monkeypatch):
    import pyarrow as pa

    entry = pa.list_(pa.struct([("source", pa.string()), ("p", pa.int64()), ("none", pa.int64())]))
    rows = [[{"source": f"s{j}", "p": 10**8 + 7 * i * j, "none": 5 + j} for j in range(i % 6)] for i in range(50)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 50), pa.array(rows, entry)], names=["lang", "at"])

    def sums():
        out = Counter()
        for b in divergence._both(iter([batch, batch.slice(10, 20)])):
            for r in b.to_pylist():
                out[r["source"], r["item"]] += r["value"]
        return out

    whole = sums()
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", 7)
    monkeypatch.setattr(divergence, "MAX_PAIRS", 3)
    assert sums() == whole and len(whole) == 20
