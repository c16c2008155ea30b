"""Personal data: regular expressions propose spans, checksums confirm them, words nearby adjust the score."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from panelweave.llm.spans import Span, add_spans

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
#: The base shapes, written so that no start inside a failed run is tried again.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})")
_IBAN_REST = re.compile(r"(?:\x20?[A-Z0-9]){11,30}")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_NOT_DIGIT = re.compile(r"[^0-9]")
#: Words that speak for a kind when they stand close by, as whole words.
NEARBY = {
    "email": ("mail", "email", "contact", "reach", "write"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "payment", "credit"),
    "phone": ("phone", "telephone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
_NEARBY = {k: re.compile(rf"(?<![^\W_])(?:{'|'.join(words)})(?![^\W_])", re.I) for k, words in NEARBY.items()}
AROUND = 40
#: The score without and with a confirming checksum, what a word nearby adds, and the least score of the added kinds.
PLAIN, CONFIRMED, NEAR, LEAST = 0.5, 0.8, 0.2, 0.7


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    text = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: each has one @, and its local part reaches back to the last match or the first other character."""
    found, last = [], 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, m.end()))
            last = m.end()
    return found


def ibans(text: str) -> list[tuple[int, int]]:
    """Where an IBAN of its country's length stands; of a country without a known length the longest run of groups that mod-97 confirms."""
    found, last = [], 0
    for m in _IBAN.finditer(text):
        start, at, size = m.start(), m.end(), 4
        if start < last:
            continue
        rest, ends = _IBAN_REST.match(text, at).end(), []
        while at < rest:
            at, size = at + (2 if text[at] == " " else 1), size + 1
            whole = at == len(text) or not (text[at].isascii() and text[at].isalnum())
            if whole and size >= 15 and size == IBAN_LENGTHS.get(text[start : start + 2], size):
                ends.append(at)
        end = next((e for e in reversed(ends) if mod97(text[start:e])), None)
        if end:
            found.append((start, end))
            last = end
    return found


def _score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    near = _NEARBY[kind]
    around = [(m.start(), m.end()) for a, b in ((start - AROUND, start), (end, end + AROUND)) for m in near.finditer(text, max(0, a), b + 1)]
    spoken_for = any(e <= start or s >= end and e <= end + AROUND for s, e in around)
    return (CONFIRMED if confirmed else PLAIN) + (NEAR if spoken_for else 0.0)


def find_pii(text: str) -> list[Span]:
    spans = [("email", s, e, False) for s, e in emails(text)]
    spans += [("ip", *m.span(), False) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits):
            spans.append(("card", *m.span(), True))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            spans.append(("phone", *m.span(), False))
    spans += [("iban", s, e, True) for s, e in ibans(text)]
    spans += [("ssn", *m.span(), False) for m in _SSN.finditer(text)]
    scored = [(k, s, e, _score(text, k, s, e, ok)) for k, s, e, ok in spans]
    return [x for x in scored if x[0] in KINDS[:4] or x[3] >= LEAST]


def pii_spans(docs: DataFrame, text_col: str = "text", out_col: str = "spans") -> DataFrame:
    """docs with the personal data of each whole text: array of (kind, start, end, score), in code points, end exclusive.

    Kinds email, ip, card and phone stay whatever their score; iban needs its checksum, ssn a whole word nearby. Null and empty texts give an
    empty array; texts of any length count whole; repeated rows each get theirs, an empty table stays empty. Spans of different kinds may overlap. Rows and all other columns
    stay as they are; a column that is named like the new one stays too, and the new one gets underscores.
    """
    return add_spans(docs, find_pii, text_col, out_col)
