"""Operator 2: personal data, also where it is disguised.

Base spans come from four plain patterns over the text as it is. Transducers then rewrite the disguises
(look-alike letters and digits, invisible characters, spelled digits, "at" and "dot" for the signs) and note for every
character they write where it came from. The same detectors read the rewritten text; what they find is mapped back to
the source characters and added unless it lies inside a base span: a base span may be the plain rest of a disguised one.

Offsets are code points, ends exclusive. Cases: null and empty texts have no spans; repeated rows stay repeated; texts of any
length are read whole, every pattern runs in linear time; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from pagemill.llm.common import known_ids, null_ids, set_up, texts

KINDS = ["email", "ip", "card", "phone"]
# fixed values: the patterns, as given
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # a start inside a run of digits fails as its first one does
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        found = EMAIL.match(text, start) if start < at else None
        if found:
            done = found.end()
            yield 0, start, done
        at = text.find("@", max(done, at + 1))


def detect(text: str) -> list[Span]:
    """Spans of all four kinds by kind and start."""
    out = list(_emails(text))
    first = _DIGIT.search(text)
    if not first:
        return out
    lo = first.start()
    if text.find(".", lo) >= 0:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text, lo) if all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split("."))]
    for m in CARD.finditer(text, lo):
        if m.end() - m.start() >= 16 and 16 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


# fixed values: Cyrillic and Greek letters that look like Latin ones
LOOK_ALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M",
    "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "․": ".", "。": ".", "﹒": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-",
    " ": " ", " ": " ", " ": " ",
}
INVISIBLE = "­​‌‍⁠﻿"
SPELLED = {"zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_WORD = "|".join(SPELLED)
_PART = rf"(?:{_WORD}|[0-9]{{1,4}})(?![^\W_])"
_RUN = re.compile(rf"(?<![^\W_])(?:plus[\x20-]+)?{_PART}(?:[\x20-]+(?:dot[\x20]+)?{_PART})++", re.I)
_TOKEN = re.compile(rf"{_WORD}|plus|dot|[0-9]+|[\x20-]+", re.I)
_SIGN = re.compile(r"[\x20]?[\[({<][\x20]?(at|dot|@|\.)[\x20]?[\])}>][\x20]?", re.I)
_NAME = "[A-Za-z0-9-]+"
# a plain "at" needs a said dot after it, or a last name of letters: "rose at 2.5 percent" is no address
_SAID_AT = rf"\x20at\x20(?={_NAME}(?:\.{_NAME})*(?:\x20dot\x20{_NAME}|\.[A-Za-z]{{2,}}(?!\.?[A-Za-z0-9-])))"
_SAID_MAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?:{_SAID_AT}|@){_NAME}(?:(?:\x20dot\x20|\.){_NAME})+", re.I)
_SAID_IP = re.compile(r"(?<![0-9])[0-9]{1,3}(?:(?:\x20dot\x20|\.)[0-9]{1,3}){3}(?![0-9])", re.I)
_SAID = re.compile(r"\x20(at|dot)\x20", re.I)


class Tape:
    """A text and, for every character, the source characters [start, end) it stands for."""

    def __init__(self, text: str):
        self.text = text
        self.start: list[int] | None = None  # characters stand for themselves until the first edit
        self.end: list[int] = []

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches, given in order and apart; a written character stands for its whole stretch."""
        if not edits:
            return
        if self.start is None:
            self.start, self.end = list(range(len(self.text))), list(range(1, len(self.text) + 1))
        out, starts, ends, at = [], [], [], 0
        for lo, hi, new in edits:
            out += [self.text[at:lo], new]
            starts += self.start[at:lo] + [self.start[lo]] * len(new)
            ends += self.end[at:lo] + [self.end[hi - 1]] * len(new)
            at = hi
        self.text = "".join([*out, self.text[at:]])
        self.start, self.end = starts + self.start[at:], ends + self.end[at:]


def plain_character(c: str) -> str:
    """The ASCII character that ``c`` imitates, nothing for an invisible one, else ``c``."""
    if c < "\x80":
        return c
    if c in INVISIBLE:
        return ""
    if "！" <= c <= "～":  # full-width forms lie at a fixed distance
        return chr(ord(c) - 0xFEE0)
    if c in LOOK_ALIKES:
        return LOOK_ALIKES[c]
    digit = unicodedata.decimal(c, None)
    return c if digit is None else str(digit)


def look_alikes(text: str) -> list[tuple[int, int, str]]:
    odd = {c: p for c in set(text) if c >= "\x80" and (p := plain_character(c)) != c}
    return [(m.start(), m.end(), odd[m[0]]) for m in re.finditer("[" + re.escape("".join(odd)) + "]", text)] if odd else []


def spelled_digits(text: str) -> list[tuple[int, int, str]]:
    """Runs of digit words become digits; a separator beside a spelled digit goes, one between numerals stays."""
    edits = []
    for m in _RUN.finditer(text):
        tokens = [(t.start(), t.end(), t[0].lower()) for t in _TOKEN.finditer(text, m.start(), m.end())]
        if sum(t in SPELLED for _, _, t in tokens) < 2:
            continue
        for k, (lo, hi, t) in enumerate(tokens):
            if t in SPELLED or t in ("plus", "dot"):
                edits.append((lo, hi, SPELLED.get(t) or {"plus": "+", "dot": "."}[t]))
            elif t[0] in " -" and (tokens[k - 1][2].isalpha() or tokens[k + 1][2].isalpha()):
                edits.append((lo, hi, ""))
    return edits


def signs(text: str) -> list[tuple[int, int, str]]:
    """Bracketed "at" and "dot", wherever they stand."""
    return [(m.start(), m.end(), "@" if m[1].lower() in ("at", "@") else ".") for m in _SIGN.finditer(text)]


def said_signs(text: str) -> list[tuple[int, int, str]]:
    """Plain "at" and "dot", only where an address forms around them."""
    edits = {}
    for pattern in (_SAID_MAIL, _SAID_IP):
        for m in pattern.finditer(text):
            for s in _SAID.finditer(text, m.start(), m.end()):
                edits[s.start()] = (s.start(), s.end(), "@" if s[1].lower() == "at" else ".")
    return [edits[k] for k in sorted(edits)]


def disguised(text: str, base: list[Span]) -> list[Span]:
    """Spans that only the rewritten text shows, mapped back; those inside a base span are left out.

    Every transducer looks at the whole text, so a span does not depend on what else the text holds.
    """
    tape = Tape(text)
    if not text.isascii():
        tape.rewrite(look_alikes(tape.text))
    tape.rewrite(signs(tape.text))
    tape.rewrite(spelled_digits(tape.text))
    low = tape.text.lower()
    if " at " in low or " dot " in low:
        tape.rewrite(said_signs(tape.text))
    if tape.text == text:
        return []
    taken = [(a, b) for _, a, b in base]
    out = []
    for kind, a, b in detect(tape.text):
        lo, hi = tape.start[a], tape.end[b - 1]
        if (hi - lo != b - a or text[lo:hi] != tape.text[a:b]) and not any(x <= lo and hi <= y for x, y in taken):
            out.append((kind, lo, hi))
    return out


def find_personal(text: str | None) -> tuple[list[Span], list[Span]]:
    """Base spans and all spans of a text, each by kind and start."""
    base = detect(text or "")
    more = disguised(text, base) if text else []
    return base, sorted(base + more) if more else base


def _told(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for doc_id, text in zip(b["doc_id"].tolist(), b["text"].tolist(), strict=True):
            base, spans = find_personal(text)
            kinds = [s[0] for s in spans]
            rows.append((doc_id, *map(kinds.count, range(4)), hashlib.sha256(_told(base).encode()).hexdigest(), _told(spans), len(spans) - len(base)))
        yield pd.DataFrame(rows, columns=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Per document: counts of all spans by kind, digest of the base spans, all spans, and how many were disguised."""
    set_up(docs.sparkSession)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    found = known_ids(texts(docs)).mapInPandas(_find, f"doc_id long, {counts}, base_sha256 string, spans string, n_disguised long")
    return null_ids(found)
