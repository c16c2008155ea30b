"""The cascade and its counts against plain versions."""

import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelweave.llm import queries, rules
from panelweave.llm.rules import BASE, MORE, Document, Measured, Rule, quality_rules
from tests.llm.conftest import EDGE, SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    repeated = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines, dup, before = [x for x in text.split("\n") if WORD.search(x)], 0, set()
    for x in lines:
        dup += x in before
        before.add(x)
    n, chars, symbols = len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text))
    failed = n < 10 or 100 * len(repeated) > 20 * n
    echoes = sum(a == b for a, b in zip(words, words[1:], strict=False))
    lettered = sum(bool(re.search("[^\x00-\x40\x5b-\x60\x7b-\x7f]", w)) for w in words)
    upper = len(re.findall("[A-Z]", text))
    kept = not (failed or 10 * symbols > n or 2 * upper > chars or chars < 2 * n or chars > 16 * n or 2 * dup > len(lines) or 100 * echoes > 40 * n or 100 * lettered < 40 * n)
    return n, chars, symbols, dup, len(repeated), failed, kept


def test_counts_and_verdicts(spark, edge, none, texts):
    tuples = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    assert tuples(queries.op13_quality_rules(spark, SF)) == sorted([(i, *plain(t)) for i, t in texts.items()], key=repr)
    assert tuples(quality_rules(edge).drop("rejected_by")) == sorted([(i, *plain(t)) for i, t in EDGE], key=repr)
    assert quality_rules(none).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "A", "é", "x|", "#", " ", " ", "\n", "\n", "\x0b", "\x1c", "\xa0", " ", "42"]), max_size=80))
def test_counts_of_odd_texts(parts):
    text = "".join(parts)
    d = Document(text)
    by = rules.first_rejecting(d, [*BASE, *MORE])
    assert (d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, by in {r.name for r in BASE}, by is None) == plain(text)


def test_a_very_long_text():
    text = "one two three four five six\n" * 100_000
    d = Document(text)
    assert (d.n_words, d.n_repeat_words, d.n_dup_lines) == (600_000, 600_000, 99_999)


def test_order_is_rejection_for_cost_of_what_is_left():
    some = tuple(Rule(n, lambda d: False) for n in "abc")
    # b alone rejects most, a costs a tenth; c rejects only what b rejects too
    found = rules.in_order(some, {0: 50, 0b010: 20, 0b110: 20, 0b001: 10}, [0.1, 1.0, 0.9])
    assert [m.rule.name for m in found] == ["a", "b", "c"] and [(m.seconds, m.rejected) for m in found] == [pytest.approx(x) for x in ((0.001, 0.1), (0.01, 40 / 90), (0.009, 0.0))]
    assert [m.rule.name for m in rules.in_order(some, {}, [0.0, 0.0, 0.0])] == ["a", "b", "c"]


@pytest.mark.parametrize("size", [1, 200])
def test_the_order_changes_no_verdict(spark, documents, size):
    measured = rules.measure(documents, size=size)
    assert {m.rule.name for m in measured} == {r.name for r in MORE}
    a = {r.doc_id: r.kept for r in quality_rules(documents, size=size).collect()}
    b = {r.doc_id: r.kept for r in quality_rules(documents, rules=tuple(reversed(MORE)), size=size).collect()}
    assert a == b


def test_a_rejected_document_is_not_shown_to_the_next_rule():
    asked = []
    watch = lambda name, verdict: Rule(name, lambda d: asked.append(name) or verdict)
    assert rules.first_rejecting(Document("x"), [watch("a", False), watch("b", True), watch("c", True)]) == "b"
    assert asked == ["a", "b"]


def test_clean_labelled_documents_stay_and_junk_goes(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    kept = {r.doc_id: (r.base_failed, r.kept) for r in queries.op13_quality_rules(spark, "/root/testdata/sf0.1").collect()}
    clean = [kept[i] for i, q in labels.items() if q == 1 and not kept[i][0]]
    junk = [kept[i] for i, q in labels.items() if q == 0]
    assert sum(k for _, k in clean) / len(clean) > 0.999 and sum(k for _, k in junk) / len(junk) < 0.01
