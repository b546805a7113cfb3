"""Operator 1: personal data, found through offset-preserving deobfuscation.

Base spans come from the text itself: e-mail addresses, IPv4 addresses, card numbers (Luhn) and phone numbers, leftmost
and non-overlapping for each kind. Then transducers rewrite disguises, one after another: look-alike letters and digits of
other alphabets, characters without width, spelled digits and look-alike letters among digits, and "at" and "dot" in
brackets or as words. Each transducer keeps a piecewise map to the text before it, so a span that is detected in the
normalised text is mapped back to the source characters it came from. A span is added if it holds a rewritten character
and does not lie inside a span of its kind; base spans always stay. A sign "@" with spaces around it counts before a domain that ends in a
short word of small letters; a lone word "at" before a plain domain ("look at example.com") is ordinary prose, and is no disguise.

Every scan is linear in the text: searches start where a match can begin only, and disguises are looked at around their
brackets and words.

Defined results: null and empty texts have no spans; offsets are code points, the end exclusive; repeated rows give repeated
rows; empty tables give empty results; other columns are not looked at, and the redacting form keeps them.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from sluice.llm._common import map_arrow, narrow, texts

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LUHN_TWICE = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)


def luhn(digits: str) -> bool:
    d = [*map(int, digits[::-1])]
    return (sum(d[::2]) + sum(LUHN_TWICE[x] for x in d[1::2])) % 10 == 0


def emails(text: str) -> list[Span]:
    """A match holds one "@" and begins where the run of local characters before it does, or where the last match ends."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL_CHARS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            floor = m.end()
        else:
            floor = max(floor, at)
        at = text.find("@", max(at + 1, floor))
    return out


def detect(text: str) -> list[Span]:
    """Spans of all kinds in a text, as it stands: by kind, then start."""
    out = emails(text) if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(g.lstrip("0")) <= 3 and int(g[-3:]) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m.group()) <= 15]
    return out


# Letters of other alphabets that look like an ASCII letter.
LOOK_ALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "У": "Y",
    "а": "a", "с": "c", "е": "e", "о": "o", "р": "p", "х": "x", "у": "y", "ѕ": "s", "і": "i", "ј": "j", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "α": "a", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "υ": "u", "ϲ": "c", "ı": "i", "ɑ": "a", "ɡ": "g", "ℓ": "l", "․": ".", "。": ".", "·": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ",
}
# Characters without width.
NO_WIDTH = "­​‌‍⁠﻿"
# Words for digits, in English, German, French and Spanish.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}


@lru_cache(maxsize=1)
def single_map() -> dict[int, str]:
    """One character for one: look-alikes, digits of any script, and letters whose compatibility form is one ASCII character."""
    out = {ord(k): v for k, v in LOOK_ALIKES.items()}
    for c in [*range(0x660, 0xFF00), *range(0xFF01, 0xFF5F), *range(0x104A0, 0x1FBFA)]:
        ch = chr(c)
        if (d := unicodedata.decimal(ch, None)) is not None:
            out[c] = str(d)
        elif 0xFF01 <= c < 0xFF5F or 0x1D400 <= c < 0x1D800 or 0x2460 <= c < 0x24EB:
            if len(n := unicodedata.normalize("NFKC", ch)) == 1 and n.isascii():
                out[c] = n
    return out


@lru_cache(maxsize=1)
def strange() -> re.Pattern:
    return re.compile("[" + "".join(map(re.escape, [*map(chr, single_map()), *NO_WIDTH])) + "]")


@dataclass
class Tape:
    """A normalised text and its map to the source: pieces (start in this text, start in the source, their lengths, kept or rewritten)."""

    text: str
    at: list[int]
    source: list[int]
    ends: list[int]
    rewritten: list[bool]

    @classmethod
    def of(cls, text: str) -> Tape:
        return cls(text, [0], [0], [len(text)], [False])

    def _source(self, i: int, end: bool) -> int:
        k = bisect_right(self.at, i - 1 if end else i) - 1
        if self.rewritten[k]:
            return self.ends[k] if end else self.source[k]
        return self.source[k] + i - self.at[k]

    def span(self, start: int, end: int) -> tuple[int, int]:
        """Source characters of a span that is not empty."""
        return self._source(start, False), self._source(end, True)

    def touched(self, start: int, end: int) -> bool:
        """Whether the span holds a rewritten piece; a removed character counts if both its neighbours are in the span."""
        a, b = bisect_right(self.at, start) - 1, bisect_right(self.at, end - 1) - 1
        return any(self.rewritten[a : b + 1]) or self.span(start, end)[1] - self.span(start, end)[0] != end - start

    def edit(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Apply replacements (start, end, new text), in order and apart from one another."""
        if not edits:
            return self
        out: list[str] = []
        new = Tape("", [], [], [], [])
        done = size = 0

        def keep(a: int, b: int) -> None:
            nonlocal size
            while a < b:
                k = bisect_right(self.at, a) - 1
                to = min(b, self.at[k + 1] if k + 1 < len(self.at) else len(self.text))
                new.at.append(size)
                new.source.append(self.source[k] if self.rewritten[k] else self.source[k] + a - self.at[k])
                new.ends.append(self.ends[k] if self.rewritten[k] else self.source[k] + to - self.at[k])
                new.rewritten.append(self.rewritten[k])
                out.append(self.text[a:to])
                size += to - a
                a = to

        for a, b, put in edits:
            keep(done, a)
            if put:
                s, e = self.span(a, b)
                new.at.append(size)
                new.source.append(s)
                new.ends.append(e)
                new.rewritten.append(True)
                out.append(put)
                size += len(put)
            done = b
        keep(done, len(self.text))
        new.text = "".join(out)
        return new


def look_alikes(tape: Tape) -> Tape:
    if tape.text.isascii():
        return tape
    one = single_map()
    return tape.edit([(m.start(), m.end(), one.get(ord(m.group()), "")) for m in strange().finditer(tape.text)])


_DIGIT = "|".join(sorted(DIGIT_WORDS, key=len, reverse=True))
SPELLED = re.compile(rf"(?<!\w)(?:plus[ \t]{{1,3}})?(?:{_DIGIT})(?:[ \t,/-]{{1,3}}(?:{_DIGIT}|[0-9]))+(?!\w)", re.I)
ONE_SPELLED = re.compile(rf"(?<!\w)(?:{_DIGIT})(?=[ \t]{{1,3}}(?:dot|point|punkt|punto)[ \t])|(?<=(?:dot|int|nkt|nto)[ \t])(?:{_DIGIT})(?!\w)", re.I)
PART = re.compile(rf"plus|{_DIGIT}|[0-9]", re.I)
AMONG_DIGITS = re.compile(r"(?:(?<=[0-9])|(?<=[0-9][ .()-])|(?<=[0-9][ -]\())[OolI|]{1,4}(?=[ .()-]?[0-9])")
HAS_SPELLED = re.compile(rf"(?<!\w)(?:{_DIGIT})[ \t,/-]{{1,3}}(?:{_DIGIT}|[0-9]|dot|point|punkt|punto)(?!\w)", re.I)


def spelled_digits(tape: Tape) -> Tape:
    """Runs of digit words become digits, with nothing between them; a lone word only between spelled dots."""
    edits = [(m.start(), m.end(), "".join("0" if c in "Oo" else "1" for c in m.group())) for m in AMONG_DIGITS.finditer(tape.text)]
    if HAS_SPELLED.search(tape.text):
        for m in SPELLED.finditer(tape.text):
            digits = "".join("+" if w.lower() == "plus" else DIGIT_WORDS.get(w.lower(), w) for w in PART.findall(m.group()))
            edits.append((m.start(), m.end(), digits))
        edits.sort()
        starts = [a for a, _, _ in edits]
        lone = []
        for m in ONE_SPELLED.finditer(tape.text):
            k = bisect_left(starts, m.end())  # edits are apart, so only the last one that begins before the word's end can meet it
            if not k or edits[k - 1][1] <= m.start():
                lone.append((m.start(), m.end(), DIGIT_WORDS[m.group().lower()]))
        edits += lone
    return tape.edit(sorted(edits))


_OPEN, _SHUT = r"\s{0,3}[\[({<]\s{0,3}", r"\s{0,3}[\])}>]\s{0,3}"
_DOTS = "dot|punkt|point|punto"
AT_IN_BRACKETS = re.compile(rf"(?<=[A-Za-z0-9._%+-]){_OPEN}(?:at|@|arroba){_SHUT}(?=[A-Za-z0-9])", re.I)
DOT_IN_BRACKETS = re.compile(rf"(?<=[A-Za-z0-9]){_OPEN}(?:{_DOTS}|\.){_SHUT}(?=[A-Za-z0-9])", re.I)
DOT_WORD = re.compile(rf"(?<=[A-Za-z0-9])\s{{1,3}}(?:{_DOTS})\s{{1,3}}(?=[A-Za-z0-9])", re.I)
AT_WORD = re.compile(r"(?<=[A-Za-z0-9._%+-])\s{1,3}(?:at|@|arroba)\s{1,3}(?=[A-Za-z0-9-]{1,63}(\x00|\.))|(?<=[A-Za-z0-9._%+-])\s{0,3}@\s{0,3}(?=[A-Za-z0-9-]{1,63}[\x00.])", re.I)
HAS_AT_DOT = re.compile(rf"[\[({{<]\s{{0,3}}(?:at|@|arroba|{_DOTS}|\.)\s{{0,3}}[\])}}>]|\s(?:{_DOTS})\s", re.I)
SPACED_AT = re.compile(r"(?<=[A-Za-z0-9._%+-])(?:\s{1,3}@\s{0,3}|@\s{1,3})(?=[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[a-z]{2,6}(?![\w.-]*[\w]))")


def at_and_dot(tape: Tape) -> Tape:
    """"at" and "dot" in brackets; "@" in spaces; as words, "at" only before a domain that has a disguised dot."""
    if "@" in tape.text:
        tape = tape.edit([(m.start(), m.end(), "@") for m in SPACED_AT.finditer(tape.text)])
    if not HAS_AT_DOT.search(tape.text):
        return tape
    tape = tape.edit([(m.start(), m.end(), "@") for m in AT_IN_BRACKETS.finditer(tape.text)])
    # A disguised dot is a mark until it is known whether "at" stands before its domain.
    dots = [(m.start(), m.end(), "\x00") for p in (DOT_IN_BRACKETS, DOT_WORD) for m in p.finditer(tape.text)]
    apart, last = [], -1
    for d in sorted(dots):
        if d[0] >= last:
            apart.append(d)
            last = d[1]
    tape = tape.edit(apart)
    ats = []
    for m in AT_WORD.finditer(tape.text):
        domain = re.compile(r"[A-Za-z0-9-]+(?:[\x00.][A-Za-z0-9-]+)*").match(tape.text, m.end())
        if domain and ("\x00" in domain.group() or m.group() == "@"):
            ats.append((m.start(), m.end(), "@"))
    tape = tape.edit(ats)
    tape.text = tape.text.replace("\x00", ".")
    return tape


#: ASCII in lower case, with a space for all but letters and digits; a byte set apart for digits.
_WORDS = bytes((b + 32 if 65 <= b <= 90 else b) if b > 127 or chr(b).isalnum() else 32 for b in range(256))
_NO_DIGITS = bytes(b for b in range(256) if not 48 <= b <= 57)
_CUES = frozenset(w.encode() for w in [*DIGIT_WORDS, *_DOTS.split("|")])
IN_BRACKETS = re.compile(rf"[\[({{<]\s{{0,3}}(?:[aA][tT]|@|[aA][rR]{{2}}[oO][bB][aA]|(?i:{_DOTS})|\.)\s{{0,3}}[\])}}>]")
DIGIT_LIKE = re.compile(r"[0-9][ .()-]{0,2}[OolI|]{1,4}[ .()-]?[0-9]")


def cues(text: str, raw: bytes) -> bool:
    """Whether a transducer might change anything. ``raw``: the text in UTF-8."""
    if not text.isascii():
        if narrow(text):
            if "\xa0" in text or "\xad" in text or "·" in text:
                return True
        elif strange().search(text):
            return True
    if not _CUES.isdisjoint(raw.translate(_WORDS).split()) and (HAS_AT_DOT.search(text) or HAS_SPELLED.search(text)):
        return True
    if (" @" in text or "@ " in text) and SPACED_AT.search(text):
        return True
    return ("[" in text or "(" in text or "{" in text or "<" in text) and IN_BRACKETS.search(text) is not None


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans: by kind, then start, then end."""
    raw = text.encode("utf-8", "surrogatepass")
    digits = bool(raw.translate(None, _NO_DIGITS))
    base = detect(text) if digits or "@" in text else []
    if not (digits and DIGIT_LIKE.search(text)) and not cues(text, raw):
        return base, base
    found = dict.fromkeys(base)
    tape = Tape.of(text)
    for step in (look_alikes, spelled_digits, at_and_dot):
        before, tape = tape, step(tape)
        if tape is before:
            continue
        for kind, a, b in detect(tape.text):
            if tape.touched(a, b):
                found.setdefault((kind, *tape.span(a, b)))
    widest: dict[str, int] = {}
    stays = set(base)
    kept = []
    for kind, a, b in sorted(found, key=lambda s: (s[1], -s[2])):
        if (kind, a, b) in stays or b > widest.get(kind, -1):
            kept.append((kind, a, b))
        widest[kind] = max(widest.get(kind, -1), b)
    return base, sorted(kept, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by its first kind in brackets."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: ``id_col``, base counts by kind, ``base_sha256``, ``spans`` and ``n_added``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, sha, every, added = [[] for _ in KINDS], [], [], []
        for t in texts(batch.column(1)):
            base, all_spans = find(t)
            for k, kind in enumerate(KINDS):
                counts[k].append(sum(s[0] == kind for s in base))
            sha.append(hashlib.sha256(joined(base).encode()).hexdigest())
            every.append(joined(all_spans))
            added.append(len(all_spans) - len(base))
        names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"]
        return pa.record_batch([batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(sha, pa.string()), pa.array(every, pa.string()), pa.array(added, pa.int64())], names=names)

    kind = df.schema[id_col].dataType.simpleString()
    return map_arrow(df, [df[id_col].alias(id_col), df[text_col].alias("__text")], run, f"{id_col} {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, n_added bigint")


def redacted(df: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """``df`` with personal data in ``text_col`` replaced; null stays null, other columns stay as they are.

    ``length_col``: a column that holds the text's length, which follows the text.
    """
    at = df.columns.index(text_col)
    length = df.columns.index(length_col) if length_col else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        new = [t if t is None else redact(t, find(t)[1]) for t in batch.column(at).to_pylist()]
        out = batch.set_column(at, batch.schema.field(at).name, pa.array(new, batch.schema.field(at).type))
        if length is None:
            return out
        size = [n if t is None else len(t) for t, n in zip(new, batch.column(length).to_pylist(), strict=True)]
        return out.set_column(length, batch.schema.field(length).name, pa.array(size, batch.schema.field(length).type))

    return map_arrow(df, [df[c] for c in df.columns], run, df.schema)
