"""Personal data, also where it is disguised, at its place in the source text.

Transducers rewrite a text character by character and keep, for every character they write, the stretch of
source characters it stands for: look-alike letters and digits become ASCII, invisible characters vanish,
spelled digits become digits, and "at" / "dot" disguises become @ and full stops. Identifiers found in what
they write are mapped back to source positions.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftgraph.llm.text import text_or_empty

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # a match, and so the next search, ends where its figures end
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int, int]  # start, kind's number, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def find_spans(text: str) -> list[Span]:
    """Plain identifiers, leftmost and non-overlapping for each kind; matches that fail a test are dropped."""
    found: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(found)


# Cyrillic and Greek letters that look like ASCII ones, other forms of @ and the full stop.
LOOKALIKES = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅαονικρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXIJSaovikpuABEZHIKMNOPTYX", strict=True))
LOOKALIKES |= {"﹫": "@", "。": ".", "․": ".", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", " ": " ", " ": " ", " ": " "}
LOOKALIKES |= {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}  # full-width forms
LOOKALIKES |= {chr(base + i): str(i) for base in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for i in range(10)}  # other digits
LOOKALIKES |= {chr(0x1D400 + 52 * k + i): chr((65 if i < 26 else 71) + i) for k in range(13) for i in range(52)}  # mathematical letters
LOOKALIKES |= {chr(0x2460 + i): str(i + 1) for i in range(9)} | {chr(0x2080 + i): str(i) for i in range(10)} | {"⁰": "0", "¹": "1", "²": "2", "³": "3"} | {chr(0x2070 + i): str(i) for i in range(4, 10)}
INVISIBLE = "­​‌‍⁠﻿"

# Spelled digits of the languages at hand.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
SPELLED |= {"null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9"}
SPELLED |= {"zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9"}
SPELLED |= {"cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9"}

_ODD = re.compile("[" + re.escape("".join(LOOKALIKES)) + INVISIBLE + "]")
_DIGIT_WORD = "(?:" + "|".join(sorted(SPELLED, key=len, reverse=True)) + ")"
#: Three spelled digits in a row, or more, also mixed with figures.
_RUN = rf"(?<!\w)(?:plus[ ,-]+)?(?:{_DIGIT_WORD}|[0-9]+)(?:[ ,.-]+(?:{_DIGIT_WORD}|[0-9]+|dot|point)(?!\w)){{2,}}"
_NUMBER_RUN, _NUMBER_RUN_LOW = re.compile(_RUN, re.I), re.compile(_RUN)
_TOKEN = re.compile(rf"{_DIGIT_WORD}|[0-9]+|plus|dot|point|[ ,.-]+", re.I)
_DOT = r"(?:\s*[\[({<]\s*(?:dot|\.)\s*[\])}>]\s*|\s+dot\s+|\.)"
_LABEL = r"[A-Za-z0-9-]+"
#: The core of an "at", without the white space around it; what stands before and after it is matched outwards from there.
_AT = re.compile(r"[\[({<]\s*(?:at|@)\s*[\])}>]|(?<=\s)at(?=\s)|@", re.I)
_DOMAIN_AFTER = re.compile(rf"{_LABEL}(?:{_DOT}{_LABEL})+", re.I)
_LOCAL_BEFORE = re.compile(r"[A-Za-z0-9_%+-]+(?:(?:\s*[\])}>]\s*(?:tod|\.)\s*[\[({<]\s*|\s+tod\s+|\.)[A-Za-z0-9_%+-]+)*", re.I)  # in the text read backwards
_DOTTED = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:\s*[\[({{<]\s*(?:dot|\.)\s*[\])}}>]\s*|\s+dot\s+|\.)[0-9]{{1,3}}(?:{_DOT}[0-9]{{1,3}}){{2}}", re.I)
_DOT_ONLY = re.compile(_DOT, re.I)
_BRACKET = re.compile(r"[\[({<]\s*(?:at|dot|@|\.)\s*[\])}>]", re.I)
_DOT_WORD = re.compile(r"\sdot\s", re.I)


class Mapped:
    """A text and, for each of its characters, the source characters it stands for."""

    __slots__ = ("text", "starts", "ends")

    def __init__(self, text: str, starts: np.ndarray | None = None, ends: np.ndarray | None = None):
        self.text = text
        self.starts = np.arange(len(text), dtype=np.int32) if starts is None else starts
        self.ends = self.starts + 1 if ends is None else ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Mapped:
        """Replace stretches (start, end, new), in order; each new character stands for the whole stretch."""
        if not edits:
            return self
        a, b = (np.array([e[k] for e in edits]) for k in (0, 1))
        size = np.array([len(e[2]) for e in edits])
        parts, at = [], 0
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            at = end
        kept = np.ones(len(self.text) + 1, dtype=np.int32)
        kept[-1] = 0
        covered = np.zeros(len(self.text) + 1, dtype=np.int32)
        np.add.at(covered, a, 1)
        np.add.at(covered, b, -1)
        kept[np.cumsum(covered) > 0] = 0
        np.add.at(kept, a, size.astype(np.int32))  # the first character of a stretch is repeated for each new one
        source = np.repeat(np.arange(kept.size), kept)
        starts, ends = self.starts[source], self.ends[source]
        new_at = np.cumsum(kept) - kept
        for i, j, k in zip(new_at[a], size, b, strict=True):
            ends[i : i + j] = self.ends[k - 1]
        return Mapped("".join([*parts, self.text[at:]]), starts, ends)

    def source(self, start: int, end: int) -> tuple[int, int]:
        return int(self.starts[start]), int(self.ends[end - 1])


def fold_lookalikes(x: Mapped) -> Mapped:
    return x.rewrite([(m.start(), m.end(), LOOKALIKES.get(m[0], "")) for m in _ODD.finditer(x.text)])


def fold_spelled(x: Mapped) -> Mapped:
    """Runs of spelled digits become figures; white space between single digits goes, other marks stay."""
    edits = []
    for m in _NUMBER_RUN.finditer(x.text):
        words = list(_TOKEN.finditer(m[0]))
        if sum(w[0].lower() in SPELLED for w in words) < 3:
            continue
        for i, w in enumerate(words):
            a, b, low = m.start() + w.start(), m.start() + w.end(), w[0].lower()
            if low in SPELLED:
                edits.append((a, b, SPELLED[low]))
            elif low == "plus":
                edits.append((a, b, "+"))
            elif low in ("dot", "point"):
                edits.append((a, b, "."))
            elif 0 < i < len(words) - 1 and not w[0].isalnum():
                edits.append((a, b, "" if words[i - 1][0].lower() == "plus" else "-" if "-" in low else "." if "." in low else ""))
    return x.rewrite(edits)


def fold_disguises(x: Mapped) -> Mapped:
    """"at" and "dot" between the parts of an address; bare words only where a bare or bracketed dot follows."""
    edits = []
    text, n, done = x.text, len(x.text), 0
    backwards = text[::-1]
    for m in _AT.finditer(text):
        if m.start() < done:
            continue
        a, b = m.span()
        while b < n and text[b].isspace():
            b += 1
        while a > done and text[a - 1].isspace():
            a -= 1
        after = _DOMAIN_AFTER.match(text, b)
        before = _LOCAL_BEFORE.match(backwards, n - a, n - done) if after else None
        if after is None or before is None:
            continue
        start, end = n - before.end(), after.end()
        done = end
        at, local, domain = text[a:b], text[start:a], after[0]
        dots = [(p + d.start(), p + d.end(), ".") for p, part in ((start, local), (b, domain)) for d in _DOT_ONLY.finditer(part) if d[0] != "."]
        if at != "@" and at.strip().lower() in ("at", "@") and not (_DOT_WORD.search(domain) or _BRACKET.search(domain)):
            continue
        edits += dots
        if at != "@":
            edits.append((a, b, "@"))
    for m in _DOTTED.finditer(x.text):
        edits += [(m.start() + d.start(), m.start() + d.end(), ".") for d in _DOT_ONLY.finditer(m[0]) if d[0] != "."]
    out: list[tuple[int, int, str]] = []
    for e in sorted(set(edits)):
        if not out or e[0] >= out[-1][1]:
            out.append(e)
    return x.rewrite(out)


def hidden_spans(text: str, base: list[Span]) -> list[Span]:
    """Identifiers that show only after the transducers, at their place in ``text``; one that overlaps base spans of its kind is wider than these."""
    low = text.lower()
    odd = not text.isascii() and _ODD.search(text) is not None
    marks = _BRACKET.search(low) is not None or (_DOT_WORD.search(low) is not None if " dot" in low or "\tdot" in low or "\ndot" in low else False)
    spelled = any(sum(w[0] in SPELLED for w in _TOKEN.finditer(m[0])) >= 3 for m in _NUMBER_RUN_LOW.finditer(low))
    if not (odd or marks or spelled):
        return []
    x = Mapped(text)
    if odd:
        x = fold_lookalikes(x)
    x = fold_disguises(fold_spelled(x))
    if x.text == text:
        return []
    taken = [([a for a, kind, _ in base if kind == k], [b for _, kind, b in base if kind == k]) for k in range(len(KINDS))]
    out = []
    for a, kind, b in find_spans(x.text):
        start, end = x.source(a, b)
        starts, ends = taken[kind]
        i, j = bisect_right(ends, start), bisect_left(starts, end)  # the plain ones between overlap it
        if i == j or start <= starts[i] and ends[j - 1] <= end and (starts[i], ends[j - 1]) != (start, end):
            out.append((start, kind, end))
    return out


def render(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` as id, spans array<struct<start, end, kind, disguised>>, in code points, end exclusive.

    Plain identifiers are always returned; disguised ones are added where they don't overlap a plain one of
    their kind, or where they are wider: the plain one was a part of them. Defined cases: a null or empty text has none; repeated rows are each searched; a null
    id is passed on; an empty table gives no rows; other columns are ignored. Time is linear in a text's
    length: disguises are matched outwards from their "at".
    """
    rows = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text"))
    schema = T.StructType([T.StructField("__id", rows.schema["__id"].dataType), *[T.StructField(c, T.ArrayType(T.IntegerType())) for c in ("start", "end", "kind")], T.StructField("disguised", T.ArrayType(T.BooleanType()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: tuple[list, list, list, list] = ([], [], [], [])
            for t in (t.as_py() for t in batch.column(1)):
                base = find_spans(t)
                spans = sorted([(*s, False) for s in base] + [(*s, True) for s in hidden_spans(t, base)])
                cols[0].append([s[0] for s in spans])
                cols[1].append([s[2] for s in spans])
                cols[2].append([s[1] for s in spans])
                cols[3].append([s[3] for s in spans])
            ints = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], ints), pa.array(cols[1], ints), pa.array(cols[2], ints), pa.array(cols[3], pa.list_(pa.bool_()))], names=["__id", "start", "end", "kind", "disguised"])

    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.transform(F.arrays_zip("start", "end", "kind", "disguised"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.element_at(names, s["kind"] + 1).alias("kind"), s["disguised"].alias("disguised")))
    return rows.mapInArrow(search, schema).select(F.col("__id").alias(id_col), spans.alias("spans"))
