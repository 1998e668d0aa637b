"""Personal data behind disguises, found with the offsets of the source text.

Two transducers rewrite a text and keep, for every character they put out, which
source characters it stands for:

1. characters: homoglyphs and width variants become ASCII, invisible ones go;
2. phrases: runs of two or more spelled digits become digits, and "at" and "dot" in
   brackets, or as words in what reads as an address, become @ and full stops.

Identifiers are detected in the result and their ends mapped back, so the spans are
offsets (in characters) of the text as it was given.

Kinds: email, ip, card (13-19 digits that pass the Luhn check), iban (check digits),
ssn, phone, secret (a value assigned to a name such as token or password). Where two
overlap, the first in that order of ``DETECTORS`` stays.

Most texts can't hold an identifier; whether they can is decided for many at once
from bytes and word hashes (``suspects``), and only the others are rewritten.

Defined results: null and empty texts have no spans; a null id stays null; repeated
rows give repeated spans; other columns are ignored by ``spans`` and carried along by
``redacted``. Texts of any length are processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, ship
from .textops import U, Words, buffers, text_chunks, words

SPANS = "doc_id long, kind string, start int, end int"

_LOOKS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "һ": "h", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "г": "r", "п": "n",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y", "І": "I", "Ј": "J", "Ѕ": "S", "З": "3",
    "α": "a", "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "γ": "y", "ε": "e", "η": "n",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "İ": "I", "ſ": "s", "ɡ": "g", "ɑ": "a", "ℓ": "l", "٠": "0", "١": "1", "٢": "2", "٣": "3", "٤": "4", "٥": "5", "٦": "6", "٧": "7", "٨": "8", "٩": "9",
    "\u2024": ".", "\u3002": ".", "\uff0e": ".", "\uff20": "@", "\ufe6b": "@", "\u2010": "-", "\u2011": "-", "\u2012": "-", "\u2013": "-", "\u2212": "-",
    "\u00a0": " ", "\u2007": " ", "\u2009": " ", "\u202f": " ", "\u3000": " ",
}
_GONE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"


class _Characters(dict):
    """str.translate table: what each character stands for; found when first met."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in _GONE:
            out = ""
        elif c in _LOOKS:
            out = _LOOKS[c]
        elif (digit := unicodedata.decimal(c, None)) is not None:
            out = str(digit)
        elif code < 0x250:
            out = c
        else:
            wide = unicodedata.normalize("NFKC", c)
            out = wide if len(wide) == 1 and wide.isascii() else c
        self[code] = out
        return out


_CHARACTERS = _Characters()
_DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_ONE = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_SPELLED = re.compile(rf"\b{_ONE}(?:[ ,\-]{{1,3}}{_ONE})+\b", re.I)
_WORD = re.compile(_ONE, re.I)
_DOTS = r"(?:dot|punkt|punto|point)"
_TLD = r"(?:com|net|org|edu|gov|info|io|biz|dev|app|example|de|fr|es|uk|ch|nl|eu|pl|se|dk|fi|ru|pt|ca|au|jp|cn|br|cz|ie|nz|kr)"
_OPEN, _CLOSE = r"\s*[(\[{<]\s*", r"\s*[)\]}>]\s*"
_PHRASES = re.compile(
    rf"(?P<at>{_OPEN}at{_CLOSE})|(?P<dot>{_OPEN}{_DOTS}{_CLOSE})"
    rf"|(?<=[\w])\s+at\s+(?=[\w\-]+(?:(?:\s+{_DOTS}\s+|{_OPEN}{_DOTS}{_CLOSE}|\.)[\w\-]+)*(?:(?:\s+{_DOTS}\s+|{_OPEN}{_DOTS}{_CLOSE})[a-z]{{2,24}}|\.{_TLD})\b(?!{_OPEN}at\b))(?P<word_at>)",
    re.I,
)
_WORD_DOT = re.compile(rf"(?<=\w)\s+{_DOTS}\s+(?=\w)", re.I)

_AROUND_AT = re.compile(rf"(?:\b\w+(?:\s+{_DOTS}\s+\w+)+)?@[\w\-]+(?:(?:\.|\s+{_DOTS}\s+)[\w\-]+)*", re.I)

_V4 = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
DETECTORS: list[tuple[str, re.Pattern]] = [
    ("secret", re.compile(r"(?<![^\W_])(?:api[_\-]?key|access[_\-]?key|secret(?:[_\-]?key)?|token|password|passwd|pwd)(?![^\W_])[\"']?\s*[:=]\s*[\"']?(?P<v>[^\s\"']{8,})", re.I)),
    ("email", re.compile(r"(?<![\w.+\-%])[\w][\w.+\-%]*@(?:[\w\-]+\.)+[A-Za-z]{2,24}(?![\w])")),
    ("iban", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")),
    ("ip", re.compile(rf"(?<![\d.]){_V4}(?:\.{_V4}){{3}}(?![\d]|\.\d)")),
    ("card", re.compile(r"(?<![\d])\d(?:[ \-]?\d){12,18}(?![\d])")),
    ("ssn", re.compile(r"(?<![\d\-])(?!000|666|9\d\d)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\d\-])")),
    ("phone", re.compile(r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3}[ .\-]\d{3,4}(?!\d)|(?<![\w+])\+\d{8,15}(?!\d)|(?<![\w+.\-])(?:\+\d{1,3}[ .\-]?\d|0\d)(?:[ .\-]\d\d){4}(?![ .\-]?\d)|(?<![\w+])\+\d{1,3}[ .\-]\(?\d{1,5}\)?[ .\-]\d{4,9}(?![ .\-]?\d)|(?<![\w+.\-])\d{3}[ \-]?\d{3}[ \-]?\d{4}(?![\w\-])")),
]


def _luhn(text: str) -> bool:
    d = [ord(c) - 48 for c in text if c.isdigit()]
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0


def _iban(text: str) -> bool:
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


CHECKS = {"card": _luhn, "iban": _iban}


def _rewrite(text: str, start: np.ndarray, end: np.ndarray, edits: list[tuple[int, int, list[tuple[str, int, int]]]]) -> tuple[str, np.ndarray, np.ndarray]:
    """Replace spans; each new character names the span it stands for."""
    parts, starts, ends, at = [], [], [], 0
    for a, b, new in edits:
        parts.append(text[at:a])
        starts.append(start[at:a])
        ends.append(end[at:a])
        for c, p, q in new:
            parts.append(c)
            starts.append(start[p : p + 1])
            ends.append(end[q - 1 : q])
        at = b
    parts.append(text[at:])
    starts.append(start[at:])
    ends.append(end[at:])
    return "".join(parts), np.concatenate(starts), np.concatenate(ends)


def normalise(text: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The rewritten text, and for each of its characters the source span [start, end)."""
    start = np.arange(len(text))
    end = start + 1
    out = text if text.isascii() else text.translate(_CHARACTERS)
    if len(out) != len(text):
        kept = np.array([len(_CHARACTERS[ord(c)]) == 1 for c in text])
        start, end = start[kept], end[kept]
    edits = []
    for m in _SPELLED.finditer(out):
        edits.append((m.start(), m.end(), [(_DIGITS[w.group().lower()], m.start() + w.start(), m.start() + w.end()) for w in _WORD.finditer(m.group())]))
    if edits:
        out, start, end = _rewrite(out, start, end, edits)
    edits = []
    found_at = "@" in out
    for m in _PHRASES.finditer(out):
        is_dot = m.group("dot") is not None
        found_at |= not is_dot
        edits.append((m.start(), m.end(), [("." if is_dot else "@", m.start(), m.end())]))
    if edits:
        out, start, end = _rewrite(out, start, end, edits)
    if found_at:
        edits = []
        for m in _AROUND_AT.finditer(out):
            edits += [(m.start() + d.start(), m.start() + d.end(), [(".", m.start() + d.start(), m.start() + d.end())]) for d in _WORD_DOT.finditer(m.group())]
        if edits:
            out, start, end = _rewrite(out, start, end, edits)
    return out, start, end


def find(text: str | None) -> list[tuple[str, int, int]]:
    """kind, start and end in source characters, by start; spans don't overlap."""
    if not text:
        return []
    out, start, end = normalise(text)
    taken: list[tuple[int, int, str]] = []
    used = bytearray(len(out))
    for kind, pattern in DETECTORS:
        group = "v" if "v" in pattern.groupindex else 0
        for m in pattern.finditer(out):
            a, b = m.span(group)
            check = CHECKS.get(kind)
            if (check is None or check(m.group(group))) and not any(used[a:b]):
                taken.append((a, b, kind))
                used[a:b] = b"\1" * (b - a)
    return [(kind, int(start[a]), int(end[b - 1])) for a, b, kind in sorted(taken)]


def _hashes(*of: str) -> np.ndarray:
    raw = " ".join(of).encode()
    return np.sort(words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])).hash)


_AT, _DOT_WORDS, _TLDS, _NAMES, _SPELL = _hashes("at"), _hashes("dot", "punkt", "punto", "point"), _hashes(*_TLD[3:-1].split("|")), _hashes("key", "apikey", "accesskey", "secretkey", "secret", "token", "password", "passwd", "pwd"), _hashes(*_DIGITS)
_ODD = np.zeros(256, bool)
_ODD[[0xC2, 0xC4, *range(0xC9, 0xF5)]] = True  # lead bytes of what the character table changes, or of what isn't part of words
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_OPENS, _CLOSES = _SPACE.copy(), _SPACE.copy()
_OPENS[list(b"([{<")] = _CLOSES[list(b")]}>")] = True
_BRACKET = _OPENS & ~_SPACE


def suspects(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents that may hold an identifier; the others can't.

    Where all bytes are ASCII or letters that the character table keeps, an address needs
    an @ or the word "at" beside brackets, or with the word for a dot or an ending, a secret one of its names, an
    account number two capitals before two digits, and all else four digits, spelled ones
    counted.
    """
    n = len(offsets) - 1
    if not len(raw):
        return np.zeros(n, bool)
    w: Words = words(raw, offsets)
    doc = w.doc()

    def per_doc(at: np.ndarray) -> np.ndarray:
        return np.bincount(np.searchsorted(offsets, at, side="right") - 1, minlength=n)[:n]

    def with_word(of: np.ndarray, after: int | None = None) -> np.ndarray:
        hit = of[np.minimum(np.searchsorted(of, w.hash), len(of) - 1)] == w.hash
        if after is not None:
            hit &= (w.start > 0) & (raw[np.maximum(w.start - 1, 0)] == after)
        return np.bincount(doc[hit], minlength=n)

    at = np.flatnonzero(w.hash == _AT[0])
    before, after = w.start[at] - 1, w.end[at]
    beside = _OPENS[raw[np.maximum(before, 0)]] & (before >= 0) & _CLOSES[raw[np.minimum(after, len(raw) - 1)]]
    inside = np.bincount(doc[at][beside], minlength=n)
    brackets = per_doc(np.flatnonzero(_BRACKET[raw])) if len(at) else inside
    has_at = np.bincount(doc[at], minlength=n) > 0
    digit = (raw >= 48) & (raw <= 57)
    places = np.flatnonzero(digit)
    capital = (raw >= 65) & (raw <= 90)
    first = places[(places >= 2) & (places < len(raw) - 1)]
    first = first[digit[first + 1] & capital[first - 1] & capital[first - 2]]
    odd = np.flatnonzero(_ODD[raw])
    latin = np.flatnonzero((raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7)) | (raw[:-1] == 0xC5) & (raw[1:] == 0xBF))  # two signs, and the long s
    return (
        (per_doc(np.flatnonzero(raw == 64)) > 0)
        | (per_doc(places) + with_word(_SPELL) >= 4)
        | (per_doc(first) > 0)
        | (per_doc(odd) > 0)
        | (per_doc(latin) > 0)
        | (has_at & ((with_word(_DOT_WORDS) > 0) | (with_word(_TLDS, 46) > 0)))
        | ((inside > 0) & (brackets > 0))
        | (with_word(_NAMES) > 0)
    )


def spans(docs: DataFrame) -> DataFrame:
    """doc_id, kind, start and end (characters of the source) of every identifier."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            at = np.flatnonzero(suspects(*buffers(batch.column("text"))))
            rows = [(i, *s) for i, t in zip(at.tolist(), batch.column("text").take(pa.array(at)).to_pylist(), strict=True) for s in find(t)]
            if rows:
                i, kind, a, b = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(i)), pa.array(kind), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["doc_id", "kind", "start", "end"])

    need = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return need.mapInArrow(run, SPANS)


def mask(text: str, found: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in found:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """All documents and columns, with identifiers in the text masked."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, "text"):
            at = np.flatnonzero(suspects(*buffers(batch.column("text"))))
            found = [(i, t, find(t)) for i, t in zip(at.tolist(), batch.column("text").take(pa.array(at)).to_pylist(), strict=True)]
            new = {i: mask(t, s) for i, t, s in found if s}
            if new:
                text = batch.column("text").to_pylist()
                for i, t in new.items():
                    text[i] = t
                k = batch.schema.get_field_index("text")
                batch = batch.set_column(k, batch.schema.field(k), pa.array(text, batch.schema.field(k).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Operator 8 over all documents."""
    return spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
