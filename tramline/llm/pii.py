"""Personal data with offset-preserving deobfuscation.

Four kinds are found in the text as it stands (the base).  Then a transducer
rewrites disguises to what they stand for: look-alike characters, spelled digits
in a row, "at" and "dot" in brackets or between names.  Each rewritten character
keeps the range of source characters it came from.  The same four kinds are
found in the rewritten text; those that touch a rewritten character and meet no
base span are mapped back to source offsets and added.

What counts as a disguise is the pattern REWRITE: up to three blanks around a sign
in brackets or a bare "at" or "dot", and after a bare "at" up to eight names of
at most 64 characters (the limit of a name in an address) before a known ending.
Both keep the time linear; longer ones are no disguise here.

Offsets count code points, ends are exclusive.  Defined results: null and empty
texts have no spans, every row gives one row, texts of any length are handled
whole in time linear in their length.  Extra input columns are left out by the
query and kept by :func:`redact`.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from tramline.llm import _common as c

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# from the first digit of a row of digits: what fails there fails from any later one, so no start is tried twice
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Look-alike characters of other scripts, and what they stand for.
GLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "п": "n", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "У": "Y", "Х": "X",
    "α": "a", "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "κ": "k", "Α": "A", "Β": "B", "Ε": "E", "Ο": "O", "Ρ": "P",
    "ı": "i", "ⅼ": "l", "․": ".", "。": ".", "﹒": ".", "·": ".", "‐": "-", "‑": "-", "–": "-", "−": "-", "﹫": "@", " ": " ",
}
# full-width forms and digits of other scripts follow a rule
GLYPHS |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
GLYPHS |= {chr(zero + i): str(i) for zero in (0x660, 0x6F0, 0x966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}
#: Spelled digits in four languages.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
_AT, _DOT = "(?:at|@|arroba|arobase)", r"(?:dot|\.|punkt|point|punto)"
_OPEN, _SHUT = r"\s{0,3}[\[({<]\s{0,2}", r"\s{0,2}[\])}>]\s{0,3}"
_NAME = r"[A-Za-z0-9_%+-]{1,64}"
#: Endings by which "a at b dot c" in bare words is told from prose.
_ENDING = "(?:com|org|net|edu|gov|mil|int|info|biz|dev|app|io|co|de|fr|es|uk|eu|us|ca|au|nz|ie|nl|ch|se|dk|fi|pl|pt|cz|hu|br|mx|ar|cl|jp|cn|kr|ru|za|example|test|invalid)"
_BARE_DOT = rf"(?:\s{{1,3}}dot\s{{1,3}}|{_OPEN}{_DOT}{_SHUT}|\.)"
REWRITE = re.compile(
    rf"(?P<at>{_OPEN}{_AT}{_SHUT})|(?P<dot>{_OPEN}{_DOT}{_SHUT})"
    rf"|(?P<pat>(?<=[A-Za-z0-9])\s{{1,3}}at\s{{1,3}}(?=(?:{_NAME}{_BARE_DOT}){{1,8}}{_ENDING}\b))"
    r"|(?P<pdot>(?<=[A-Za-z0-9])\s{1,3}dot\s{1,3}(?=[A-Za-z0-9]))"
    rf"|(?P<plus>\bplus[ -]{{1,2}}(?={_DIGIT}\b))"
    rf"|(?P<digits>\b{_DIGIT}(?:[ ,-]{{1,2}}{_DIGIT}){{2,}}\b)"
    rf"|(?P<glyph>(?-i:[{re.escape(''.join(GLYPHS))}]))",  # without regard to case, a dotless i would be any i
    re.IGNORECASE,
)
_SPELLED = re.compile(_DIGIT, re.IGNORECASE)
_GLYPH = re.compile(f"[{re.escape(''.join(GLYPHS))}]")
_BRACKETED = re.compile(rf"[\[({{<]\s{{0,2}}(?:{_AT}|{_DOT})\s{{0,2}}[\])}}>]", re.IGNORECASE)
_BARE = re.compile(r"\sdot\s")
_BARE_AT = re.compile(rf"\sat\s{{1,3}}(?=(?:{_NAME}{_BARE_DOT}){{1,8}}{_ENDING}\b)", re.IGNORECASE)
_PLUS = re.compile(rf"plus[ -]{{1,2}}{_DIGIT}")
_APART = str.maketrans(",-", "  ")
_NO_WORD = re.compile(r"\W+")
#: What IGNORECASE takes for an i or an s, and lower() does not.
_FOLD = str.maketrans("ıİſ", "iis")


def cue(text: str) -> bool:
    """Whether REWRITE may match anywhere: true wherever it does, seldom elsewhere, as each look is one fast scan."""
    if not text.isascii() and _GLYPH.search(text) or _BRACKETED.search(text) or _BARE_AT.search(text):
        return True
    low = (text if text.isascii() else text.translate(_FOLD)).lower()
    if "dot" in low and _BARE.search(low) or "plus" in low and _PLUS.search(low):
        return True
    words = (low.translate(_APART) if "," in low or "-" in low else low).split()
    # a digit between two others is a whole word; the first of a row may follow, the last may precede other signs
    for i in [i for i, w in enumerate(words[1:-1], 1) if w in SPELLED]:
        if _NO_WORD.split(words[i - 1])[-1] in SPELLED and _NO_WORD.split(words[i + 1])[0] in SPELLED:
            return True
    return False


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = ord(ch) - 48
        if i % 2 and (d := 2 * d) > 9:
            d -= 9
        total += d
    return total % 10 == 0


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the four kinds, in order."""
    out = []
    last, at = 0, text.find("@")
    while at >= 0:
        if m := _DOMAIN.match(text, at):
            s = at
            while s > last and text[s - 1] in _LOCAL:
                s -= 1
            if s < at:
                out.append((s, 0, m.end()))
                last = m.end()
                at = text.find("@", last)
                continue
        at = text.find("@", at + 1)
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(small, m.groups()))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = _NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(out)


def rewritten(text: str) -> tuple[str, list[tuple[int, int, int, int]]]:
    """The normalised text, and for each rewritten character (its place, source start, source end, place after it)."""
    out, marks, at, place = [], [], 0, 0

    def put(ch: str, s: int, e: int) -> None:
        nonlocal at, place
        if s > at:
            out.append(text[at:s])
            place += s - at
        out.append(ch)
        marks.append((place, s, e, place + 1))
        place, at = place + 1, e

    for m in REWRITE.finditer(text):
        kind = m.lastgroup
        if kind == "digits":
            for d in _SPELLED.finditer(text, m.start(), m.end()):
                # the white space before a digit of the row goes with it
                put(SPELLED[d.group().translate(_FOLD).lower()], d.start() if d.start() == m.start() else at, d.end())
        elif kind == "glyph":
            put(GLYPHS.get(m.group()) or GLYPHS.get(m.group().lower(), m.group()), m.start(), m.end())
        else:
            put({"at": "@", "pat": "@", "plus": "+"}.get(kind, "."), m.start(), m.end())
    out.append(text[at:])
    return "".join(out), marks


def added_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not cue(text):
        return []
    plain, marks = rewritten(text)
    if not marks:
        return []
    places = [m[0] for m in marks]

    def source(k: int, end: bool) -> int:
        """Source offset of the character at place k: where it starts or ends."""
        i = bisect_right(places, k) - 1
        if i < 0:
            return k + end
        place, s, e, after = marks[i]
        if k == place:
            return e if end else s
        return e + (k - after) + end

    out, starts = [], [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # how far the base spans go that start here or before
    for s, kind, e in base_spans(plain):
        i = bisect_right(places, s - 1)
        if i == len(places) or places[i] >= e:
            continue  # nothing in it was rewritten
        first, last = source(s, False), source(e - 1, True)
        # white space that went with a disguise at an end is no part of it
        while first < last and text[first].isspace():
            first += 1
        while last > first and text[last - 1].isspace():
            last -= 1
        j = bisect_right(starts, last - 1)
        if not j or reach[j - 1] <= first:
            out.append((first, kind, last))
    return out


def find(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, as (start, kind, end) in order."""
    if not text:
        return [], []
    base = base_spans(text)
    more = added_spans(text, base)
    return base, sorted(base + more) if more else base


def told(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for s, k, e in spans])


def covered(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; where spans overlap, the one that starts first."""
    out, at = [], 0
    for s, k, e in spans:
        if e <= at:
            continue
        if s >= at:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        at = e
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added) of every row; the four counts are of base spans."""
    c.ready(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [find(t.as_py()) for t in part.column(1)]
            counts = [pa.array([sum(k == j for _, k, _ in b) for b, _ in got], pa.int64()) for j in range(4)]
            yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([hashlib.sha256(told(b).encode()).hexdigest() for b, _ in got], pa.string()), pa.array([told(a) for _, a in got], pa.string()), pa.array([len(a) - len(b) for b, a in got], pa.int64())], names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(docs: DataFrame, text_col: str = "text", size_col: str | None = None) -> DataFrame:
    """The input with spans replaced in the text, and ``size_col``, if given, set to the new length where it was set."""
    c.ready(docs.sparkSession)
    at = docs.columns.index(text_col)
    size = docs.columns.index(size_col) if size_col else -1

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [None if t is None else covered(t, find(t)[1]) for t in (x.as_py() for x in part.column(at))]
            columns = list(part.columns)
            columns[at] = pa.array(texts, part.schema.field(at).type)
            if size >= 0:
                columns[size] = pa.array([None if t is None else len(t) for t in texts], part.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=part.schema)
        c.trim()

    return docs.mapInArrow(run, docs.schema)
