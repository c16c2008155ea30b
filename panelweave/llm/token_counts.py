"""Token counts by a two-tier lookup on the map side; no pre-token is ever shuffled.

Tier 1 is a broadcast table of the corpus's frequent pre-tokens and their lengths in tokens; it has at most
`TABLE_SIZE` entries of at most `KEY_CHARS` characters, whatever the corpus and its script. Texts of plain Latin letters are split by a pattern of our own,
others by the tokenizer's normaliser and splitter, whose pre-tokens spell bytes as characters; where the two spellings differ, the key says so. It is found by one pass over all texts in which
each task keeps a bounded count (lossy counting) and the summaries are merged in a tree. Tier 2 is a cache in each
Python worker: what the table misses is encoded once and remembered. Both tiers only save time; a count is always
the tokenizer's own.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from panelweave.llm.common import id_and_text, record, slices, texts_of

TABLE_SIZE = 16_384
KEY_CHARS = 64
CACHE_SIZE = 400_000
#: Marks a key that spells bytes; no plain key has a character as high.
BYTES = "\u2400"
SPECIAL = ("<|startoftext|>", "<|endoftext|>")  # fixed values: the vocabulary's added tokens

#: Up to U+017F, without U+0130, lower-casing and NFC are plain and the classes below are those of the vocabulary's pattern.
_PLAIN_END = 0x180
_OTHER = re.compile(f"[^\x00-{chr(_PLAIN_END - 1)}]|İ")


def _class(kinds: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(_PLAIN_END) if unicodedata.category(chr(c))[0] in kinds)


_L, _N, _S = _class("L"), _class("N"), "\t-\r \x85\xa0"
_PRE_TOKEN = re.compile(f"[{_L}]+|[{_N}]|'(?:[stmd]|re|ve|ll)|[^{_S}{_L}{_N}]+")

_tokenizers: dict[str, object] = {}
_cache: dict[str, int] = {}


def _tokenizer(path: str):
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _tokenizers.clear()
        _cache.clear()
        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


def pre_tokens(text: str, tokenizer) -> list[str]:
    """The keys of the text's pre-tokens: themselves in lower case, or BYTES and what the tokenizer's splitter spells where that is not plain ASCII."""
    if not _OTHER.search(text):
        return _PRE_TOKEN.findall(text.lower())
    mapped = (p for p, _ in tokenizer.pre_tokenizer.pre_tokenize_str(tokenizer.normalizer.normalize_str(text)))
    return [p if p.isascii() else BYTES + p for p in mapped]


def encoded_lengths(keys: list[str], tokenizer) -> dict[str, int]:
    """Tokens of each key, by the tokenizer."""
    plain = [k for k in keys if k[:1] != BYTES]
    found = {k: len(e.ids) for k, e in zip(plain, tokenizer.encode_batch(plain, add_special_tokens=False), strict=True)}
    return found | {k: len(tokenizer.model.tokenize(k[1:])) for k in keys if k[:1] == BYTES}


def count_tokens(text: str, frequent: dict[str, int], tokenizer) -> int:
    if any(s in text for s in SPECIAL):
        return len(tokenizer.encode(text, add_special_tokens=False).ids)
    first, second = frequent.get, _cache.get
    keys = pre_tokens(text, tokenizer)
    lengths = [first(k) or second(k) or 0 for k in keys]
    if 0 in lengths:
        found = encoded_lengths(list({k for k, n in zip(keys, lengths, strict=True) if not n}), tokenizer)
        if len(_cache) > CACHE_SIZE:
            _cache.clear()
        _cache.update((k, n) for k, n in found.items() if len(k) <= KEY_CHARS)
        return sum(n or found[k] for k, n in zip(keys, lengths, strict=True))
    return sum(lengths)


def _trim(counts: Counter) -> Counter:
    return Counter(dict(counts.most_common(TABLE_SIZE)))


def frequent_pre_tokens(texts: DataFrame, tokenizer_path: str) -> list[str]:
    """At most TABLE_SIZE frequent pre-tokens of all texts; one bounded summary leaves each task."""

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, own = Counter(), _tokenizer(tokenizer_path)
        for batch in slices(batches, "text"):
            for text in texts_of(batch, "text"):
                counts.update(pre_tokens(text, own))
                if len(counts) > 8 * TABLE_SIZE:
                    counts = _trim(counts)
        top = [(w, n) for w, n in _trim(counts).items() if len(w) <= KEY_CHARS]
        yield pa.RecordBatch.from_pydict({"words": [[w for w, _ in top]], "counts": [[n for _, n in top]]}, schema=pa.schema([("words", pa.list_(pa.string())), ("counts", pa.list_(pa.int64()))]))

    def merge(a: Counter, b: Counter) -> Counter:
        a.update(b)
        return _trim(a) if len(a) > 2 * TABLE_SIZE else a

    rows = texts.select("text").mapInArrow(summary, "words array<string>, counts array<long>").rdd
    merged = rows.map(lambda r: Counter(dict(zip(r.words, r.counts, strict=True)))).treeAggregate(Counter(), merge, merge, depth=2)
    return [w for w, _ in sorted(merged.items(), key=lambda x: (-x[1], x[0]))[:TABLE_SIZE]]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row.

    A null text counts as empty (0 bytes, 0 tokens); a null id stays null; repeated rows each give a row; an empty
    table gives an empty result. Whole texts are counted, however long.
    """
    texts = id_and_text(docs, id_col, text_col)
    tokenizer = _tokenizer(tokenizer_path)
    shared = texts.sparkSession.sparkContext.broadcast(encoded_lengths(frequent_pre_tokens(texts, tokenizer_path), tokenizer))
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, frequent = _tokenizer(tokenizer_path), shared.value
        for batch in slices(batches, "text"):
            n = [count_tokens(t, frequent, own) for t in texts_of(batch, "text")]
            yield record(schema, [batch.column(0), pc.fill_null(pc.binary_length(batch.column(1)), 0), n, [x > limit for x in n]])

    return texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
