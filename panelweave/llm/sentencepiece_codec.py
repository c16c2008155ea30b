"""SentencePiece BPE by a table of last tokens, and the way back.

The encoding of a prefix ends in one token that is unique: of all pieces that an automaton finds to end there, the one that is compatible
with the last token of the prefix before it. Two tokens are compatible if merging their joined text gives exactly the two. The ids are
then read backwards from the end. As no piece has a space mark after another character, words with the space marks before them are
encoded independently; a worker remembers those it has seen.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from panelweave.llm.common import id_and_text, record, slices, texts_of

SPACE = "▁"
CACHE_SIZE = 500_000
KEY_CHARS = 48
#: Texts that other normalisers or space rules would change.
PROBES = (" a  b ", "\ta\nb\r", "\uff21\ufb01 \u2460 e\u0301 \u00e9", "\u00a0\u3000x\u200b", "\u2581a \u2581", "ABC abc", "x\x00y")


class Codec:
    def __init__(self, model_path: str) -> None:
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_path)
        self.size = model.vocab_size()
        self.pieces = [model.id_to_piece(i) for i in range(self.size)]
        plain = [i for i in range(self.size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.scores = {self.pieces[i]: model.get_score(i) for i in plain}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(self.size) if model.is_byte(i)}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids) or any(c not in self.ids for p in self.ids for c in p):
            raise ValueError("not a vocabulary whose words are encoded independently")
        self.automaton = ahocorasick.Automaton()
        for piece, i in self.ids.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.chars = [len(p) for p in self.pieces]
        # a byte below 128 is a character of its own; others are None and decoded together
        self.shown = [(chr(b) if (b := self.bytes_of[i]) < 128 else None) if i in self.bytes_of else "" if model.is_control(i) else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        self.pairs: dict[int, bool] = {}
        self.words: dict[str, list[int]] = {}
        if any(self.encode(t) != model.encode(t) for t in PROBES):
            raise ValueError("the model normalises texts or marks spaces in another way")

    def merged(self, text: str) -> list[str]:
        """The pieces that merging gives: the best-scored neighbours first, then the leftmost."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = float("-inf"), -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, key: int) -> bool:
        """Whether two tokens (left * size + right; left -1: none) stay as they are when their joined text is merged."""
        if len(self.pairs) > 4 * CACHE_SIZE:
            self.pairs.clear()
        left, right = divmod(key, self.size)
        parts = [self.pieces[i] for i in (left, right) if i >= 0]
        known = self.pairs[key] = self.merged("".join(parts)) == parts
        return known

    def encode_word(self, word: str) -> list[int]:
        last = [-1] * (len(word) + 1)  # the prefix table; -1 after an unknown character
        known, size = self.pairs.get, self.size
        for end, (token, chars) in self.automaton.iter(word):
            end += 1
            if last[end] < 0:
                key = last[end - chars] * size + token
                fits = known(key)
                if self.compatible(key) if fits is None else fits:
                    last[end] = token
        out: list[int] = []
        at = len(word)
        while at:
            token = last[at]
            if token < 0:
                at -= 1
                out += [self.byte_ids[b] for b in reversed(word[at].encode())]
            else:
                out.append(token)
                at -= self.chars[token]
        out.reverse()
        return out

    def decode(self, ids: list[int]) -> str:
        """The ids' text, without the space that encoding puts first."""
        parts = list(map(self.shown.__getitem__, ids))
        for at in [i for i, p in enumerate(parts) if p is None] if None in parts else ():
            if parts[at] is not None:
                continue
            end = at
            while end < len(parts) and parts[end] is None:
                end += 1
            parts[at] = bytes(map(self.bytes_of.__getitem__, ids[at:end])).decode(errors="replace")
            parts[at + 1 : end] = [""] * (end - at - 1)
        return "".join(parts)[1:]

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        ids: list[int] = []
        known = self.words.get
        for word in _WORD.findall(SPACE + text.replace(" ", SPACE)):
            own = known(word)
            if own is None:
                own = self.encode_word(word)
                if len(word) <= KEY_CHARS:
                    if len(self.words) > CACHE_SIZE:
                        self.words.clear()
                    self.words[word] = own
            ids += own
        return ids


_WORD = re.compile(f"{SPACE}+[^{SPACE}]*")
_codecs: dict[str, Codec] = {}


def codec(model_path: str) -> Codec:
    if model_path not in _codecs:
        _codecs.clear()
        _codecs[model_path] = Codec(model_path)
    return _codecs[model_path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) and decoded (string) of every whole text, however long.

    A null text counts as empty: no ids, empty string. A null id stays null; repeated rows each give a row; an empty table an empty result; further
    columns, whatever their names, aren't read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model_path)
        for batch in slices(batches, "text"):
            ids = [own.encode(t) for t in texts_of(batch, "text")]
            yield record(schema, [batch.column(0), ids, [own.decode(x) for x in ids]])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
