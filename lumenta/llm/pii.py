"""Personal data with offset-preserving deobfuscation.

A base pass matches e-mail addresses, IP addresses, card and phone numbers in the text as it stands. A transducer then
rewrites disguises (look-alike letters, full-width forms, invisible characters, spelled digits, "at"/"dot" forms) and
keeps, for every character it writes, the span of source characters it came from. The same patterns run on its output,
and their spans are mapped back. Added spans never displace base ones. Texts are worked on whole, in code points.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm.common import slices

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
#: The same matches: a match starts where a run of digits does, and takes whole runs, so nothing is tried again.
IP_RUNS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DIGIT = re.compile(r"[0-9]")
NO_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of EMAIL, found from their @ outwards, as most texts have few."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := EMAIL.match(text, start)):
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def detect(text: str) -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        out["email"] = list(_emails(text))
    if DIGIT.search(text):
        out["ip"] = [m.span() for m in IP_RUNS.finditer(text) if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split("."))]
        for m in CARD.finditer(text):
            digits = NO_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out["card"].append(m.span())
        if "+" in text:
            out["phone"] = [m.span() for m in PHONE.finditer(text) if 9 <= len(NO_DIGIT.sub("", m[0])) <= 15]
    return out


# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = dict(zip("аеорсухѕіјԁһӏАВЕКМНОРСТУХοανικρυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxsijdhlABEKMHOPCTYXoavikpuABEZHIKMNOPTYX", strict=True))
HOMOGLYPHS |= {"．": ".", "。": ".", "․": ".", "·": ".", "＠": "@", "﹫": "@", "＋": "+", "－": "-", "‐": "-", "‑": "-", "‒": "-", "–": "-", " ": " ", " ": " ", " ": " "}
INVISIBLE = frozenset("​‌‍⁠﻿­‎‏")
# Spelled digits.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "oh": "0",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
#: Four or more spelled or plain digits in a row; fewer are ordinary prose.
SPELLED_RUN = re.compile(rf"(?<![^\W_])(?:plus\s+)?(?:(?:{_DIGIT_WORD})|[0-9])(?:[ \t,.-]{{1,2}}(?:(?:{_DIGIT_WORD}|dot|point|dash)(?![^\W_])|[0-9]+(?![^\W_]))){{3,}}", re.IGNORECASE)
SPELLED_PART = re.compile(rf"{_DIGIT_WORD}|plus|dot|point|dash|[0-9]+|[ \t,.-]+", re.IGNORECASE)
SPELLED_HINT = re.compile(rf"(?<![^\W_])(?:{_DIGIT_WORD})[ \t,.-]{{1,2}}(?:{_DIGIT_WORD}|[0-9])", re.IGNORECASE)
DOT = r"(?:\s*[(\[{<]\s*(?:dot|punkt|point|punto|\.)\s*[)\]}>]\s*|\s+(?:dot|punkt|point|punto)\s+|\.)"
#: The middle of a disguised @: in brackets, spelled between spaces, or next to spaces.
AT_CORE = re.compile(r"[(\[{<]\s*(?:at|@|arroba)\s*[)\]}>]|(?<=\s)at(?=\s)|(?<=\s)@|@(?=\s)", re.IGNORECASE)
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_%+-")
HOST = re.compile(rf"[A-Za-z0-9-]++(?:{DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
DOT_WORDS = ("dot", "punkt", "point", "punto")
DISGUISED_HINT = re.compile(r"[(\[{<]\s*(?:at|@|arroba|dot|punkt|point|punto|\.)\s*[)\]}>]|\s(?:dot|punkt|point|punto)\s|\s@|@\s", re.IGNORECASE)
DOTS = re.compile(DOT, re.IGNORECASE)
IP_DOTS = re.compile(r"(?<![0-9.])([0-9]{1,3})((?:\s*[(\[{]\s*(?:dot|\.)\s*[)\]}]\s*|\s+dot\s+|\.)[0-9]{1,3}){3}(?![0-9])", re.IGNORECASE)


class Tape:
    """A rewritten text, and for each of its characters the span of source characters it stands for."""

    def __init__(self, text: str):
        self.text, self.starts, self.ends = text, None, None

    def span(self, start: int, end: int) -> tuple[int, int]:
        return (start, end) if self.starts is None else (self.starts[start], self.ends[end - 1])

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """edits: (start, end, what stands there instead), in order and apart."""
        if not edits:
            return
        starts, ends = (range(len(self.text)), range(1, len(self.text) + 1)) if self.starts is None else (self.starts, self.ends)
        text, at, new_starts, new_ends = [], 0, [], []
        for s, e, put in edits:
            text += [self.text[at:s], put]
            new_starts += starts[at:s]
            new_ends += ends[at:s]
            new_starts += [starts[s]] * len(put)
            new_ends += [ends[e - 1]] * len(put)
            at = e
        text.append(self.text[at:])
        new_starts += starts[at:]
        new_ends += ends[at:]
        self.text, self.starts, self.ends = "".join(text), new_starts, new_ends


def _odd(c: str) -> str | None:
    """What a single character is folded to, if to anything else."""
    if c in INVISIBLE:
        return ""
    if c in HOMOGLYPHS:
        return HOMOGLYPHS[c]
    if "！" <= c <= "～" or "\U0001d400" <= c <= "\U0001d7ff" or unicodedata.category(c) == "Nd" and not c.isascii():
        folded = unicodedata.normalize("NFKC", c)
        if not folded.isascii() and c.isdigit():
            folded = str(unicodedata.digit(c))
        return folded if folded.isascii() and folded != c else None
    return None


#: Outside the Latin letters that are left alone; most texts have no such character.
FOLDABLE = re.compile("[ ­·Ͱ-ԯ٠-๙က-᧿​- ⁠。﹫﻿！-～\U0001d400-\U0001d7ff]")


def _back(text: str, at: int, floor: int) -> int:
    """The start of the white space that ends at a place."""
    while at > floor and text[at - 1].isspace():
        at -= 1
    return at


def _dot_before(text: str, end: int, floor: int) -> int:
    """The start of a dot, bare or disguised, that ends at a place; -1 if there is none."""
    if end > floor and text[end - 1] == ".":
        return end - 1
    at = _back(text, end, floor)
    if at == floor:
        return -1
    closed = text[at - 1] in ")]}>"
    if closed:
        at = _back(text, at - 1, floor)
    elif at == end:
        return -1
    for word in DOT_WORDS if not closed else (*DOT_WORDS, "."):
        start = at - len(word)
        if start >= floor and text[start:at].lower() == word:
            at = _back(text, start, floor)
            if closed:
                return _back(text, at - 1, floor) if at > floor and text[at - 1] in "([{<" else -1
            return at if at < start else -1
    return -1


def _name_before(text: str, end: int, floor: int) -> tuple[int, list[tuple[int, int]]]:
    """The start of the longest chain of names and dots that ends at a place (the place itself if there is none), and the dots' spans."""
    start, dots, held = end, [], []
    while True:
        at = end
        while at > floor and text[at - 1] in NAME:
            at -= 1
        if at == end:
            return start, dots[::-1]
        start, end = at, _dot_before(text, at, floor)
        dots, held = held, [*held, (end, at)]
        if end < 0:
            return start, dots[::-1]


def _disguised(text: str) -> list[tuple[int, int, str]]:
    """Edits that turn disguised addresses into plain ones. They are found from their @ outwards, each part of a text at most once from either side."""
    edits: list[tuple[int, int, str]] = []
    floor = 0
    for m in AT_CORE.finditer(text):
        if m.start() < floor:
            continue
        left, right = _back(text, m.start(), floor), m.end()
        while right < len(text) and text[right].isspace():
            right += 1
        start, dots = _name_before(text, left, floor)
        if start == left or not (host := HOST.match(text, right)):
            continue
        ends = [d.span() for d in DOTS.finditer(host[0])]
        if m[0][0] not in "([{<@" and all(host[0][a:b] == "." for a, b in ends):
            continue  # "look at example.com" is prose
        edits += [(a, b, ".") for a, b in dots] + [(left, right, "@")] + [(right + a, right + b, ".") for a, b in ends]
        floor = host.end()
    return edits


def deobfuscate(text: str) -> Tape:
    tape = Tape(text)
    if FOLDABLE.search(text):
        tape.rewrite([(m.start(), m.end(), put) for m in FOLDABLE.finditer(text) if (put := _odd(m[0])) is not None])
    if SPELLED_HINT.search(tape.text):
        edits = []
        for run in SPELLED_RUN.finditer(tape.text):
            for m in SPELLED_PART.finditer(tape.text, *run.span()):
                word = m[0].lower()
                put = {"plus": "+", "dot": ".", "point": ".", "dash": "-"}.get(word) or SPELLED.get(word)
                if put is None:
                    put = word if word[0].isdigit() else "." if "." in word and not edits else ""
                edits.append((m.start(), m.end(), put))
        tape.rewrite(edits)
    if DISGUISED_HINT.search(tape.text):
        tape.rewrite(_disguised(tape.text))
        if DIGIT.search(tape.text):
            tape.rewrite([(m.start() + d.start(), m.start() + d.end(), ".") for m in IP_DOTS.finditer(tape.text) for d in DOTS.finditer(m[0])])
    return tape


def spans_of(text: str | None) -> tuple[dict[str, list[tuple[int, int]]], dict[str, list[tuple[int, int]]]]:
    """Base spans, and base and added spans together, by kind. Added spans that touch a base span of any kind are dropped."""
    text = text or ""
    base = detect(text)
    tape = deobfuscate(text)
    if tape.starts is None:
        return base, base
    taken: list[list[int]] = []  # what base spans cover, apart and in order
    for a, b in sorted(x for own in base.values() for x in own):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    ends, every = [b for _, b in taken], {}
    for kind, found in detect(tape.text).items():
        added = []
        for s, e in dict.fromkeys(tape.span(*x) for x in found):
            k = bisect_right(ends, s)
            if k == len(taken) or taken[k][0] >= e:
                added.append((s, e))
        every[kind] = sorted({*base[kind], *added})
    return base, every


def joined(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in KINDS for s, e in spans[k])


def found(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, base and spans (kind:start:end lists), and the matches' texts.

    n_<kind> counts base and added spans. Null and empty texts have no spans; repeated rows and null ids stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [(joined(b), e, t) for t in batch.column(1).to_pylist() for b, e in [spans_of(t)]]
            rows = [
                batch.column(0),
                *(pa.array([len(e[k]) for _, e, _ in made], pa.int64()) for k in KINDS),
                pa.array([b for b, _, _ in made], pa.string()),
                pa.array([joined(e) for _, e, _ in made], pa.string()),
                pa.array([[(t or "")[s:x] for k in KINDS for s, x in e[k]] for _, e, t in made], pa.list_(pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(rows, names=["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans", "texts"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base string, spans string, texts array<string>")


def redact(text: str | None) -> str | None:
    """The text with each span, base or added, replaced by its kind in brackets."""
    if not text:
        return text
    _, every = spans_of(text)
    out, at = [], 0
    for s, e, k in sorted((s, e, k) for k in KINDS for s, e in every[k]):
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        elif e <= at:
            continue
        at = max(at, e)
    return "".join([*out, text[at:]])

