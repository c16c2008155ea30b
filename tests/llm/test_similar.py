"""Families of similar texts against brute-force Jaccard similarities."""

from random import Random

import pytest

import corpus_pipeline as cp
from panelweave.llm import similar, simhash
from tests.llm.conftest import SF


def slow_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def slow_families(texts):
    """The sets of distinct texts (null as empty) that similarities of at least 0.8 connect; wordless ones are alike."""
    texts = sorted({t or "" for t in texts})
    sets, family = [slow_shingles(t) for t in texts], list(range(len(texts)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or (5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and 5 * len(x & y) >= 4 * len(x | y)):
                family = [family[j] if f == family[i] else f for f in family]
    groups = {}
    for t, f in zip(texts, family, strict=True):
        groups.setdefault(f, set()).add(t)
    return list(groups.values())


def slow_kept(rows):
    """Of (id, text) rows those that stay: of each family the smallest id, an absent id last."""
    place = {}
    for i, t in rows:
        key = (i is None, i or 0)
        place[t or ""] = min(place.get(t or "", key), key)
    return {min(place[t] for t in g) for g in slow_families(t for _, t in rows)}


def near_copies():
    """Texts with 1 to 9 of 100 words replaced, which are similar or not by a hair, a dense family and short texts."""
    r, texts = Random(5), ["a b", "a b c", "one two three four five", "one two three four five six", "same few words here", "SAME  few words\there", "", None]
    for n in range(60):
        words = [f"w{r.randrange(10**6)}" for _ in range(100)]
        texts.append(" ".join(words))
        for at in r.sample(range(100), 1 + n % 4):
            words[at] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(words))
    words = [f"v{i}" for i in range(150)]
    for _ in range(40):
        texts.append(" ".join([*words, *(f"y{r.randrange(10**6)}" for _ in range(r.randrange(60)))]))
    return texts


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("chunk", [7, 1024])
def test_families_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(similar, "CHUNK_TEXTS", chunk)
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    docs = frame(spark, near_copies())
    found = {}
    for x in docs.selectExpr("coalesce(text, '') AS text").selectExpr("text", "xxhash64(text) AS text_key").join(similar.similar_families(docs), "text_key").collect():
        found.setdefault(x.root, set()).add(x.text)
    expected = slow_families(near_copies())
    assert sum(len(g) > 1 for g in expected) > 20 and sorted(map(sorted, found.values())) == sorted(map(sorted, expected))
    assert similar.similar_families(docs.where("false")).count() == 0


def test_one_family_holds_most_rows(spark):
    """Copies and near copies of one text, most of which are similar only through that text."""
    r = Random(8)
    base = [f"b{i}" for i in range(120)]
    texts = [" ".join(base)] * 300
    for _ in range(400):
        words = list(base)
        for at in r.sample(range(120), r.randrange(1, 9)):
            words[at] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [" ".join(f"o{r.randrange(10**6)}" for _ in range(40)) for _ in range(60)]
    kept = cp.remove_near_duplicates(spark, frame(spark, texts), SF).collect()
    assert sorted((False, x.doc_id) for x in kept) == sorted(slow_kept(list(enumerate(texts))))


def test_the_smallest_id_of_each_family_stays(spark, documents):
    texts = near_copies()
    kept = cp.remove_near_duplicates(spark, frame(spark, texts), SF).collect()
    assert {(False, x.doc_id) for x in kept} == slow_kept(list(enumerate(texts))) and len(kept) == len(slow_families(texts))
    rows = [(x.doc_id, x.text) for x in documents.collect()]
    kept = cp.remove_near_duplicates(spark, documents, SF).collect()
    assert {(False, x.doc_id) for x in kept} == slow_kept(rows)


def test_components_over_many_blocks(spark, monkeypatch):
    from panelweave.llm import components as c

    r = Random(3)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(500)] + [(r.randrange(3000, 6000), r.randrange(3000, 6000)) for _ in range(1200)] + [(7, 7), (5000, 1000)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    expected = sorted((x, find(x)) for x in list(root))
    frame = spark.createDataFrame([*links, (None, 3)], "a long, b long").repartition(5)
    for block in (50, 1 << 18):
        monkeypatch.setattr(c, "BLOCK", block)
        assert sorted(map(tuple, c.components(frame).collect())) == expected
    assert c.components(frame.where("false")).count() == 0
