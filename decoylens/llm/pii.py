"""Personal data, also where it is disguised: normalise, detect, and map what was found back to the source text.

Three transducers rewrite a text, each with a map from its output to its input: look-alike characters and invisible
ones (``fold``), spelled digits (``digits``), and at/dot disguises (``signs``). The same detectors run on the source
and on the rewritten text; spans of the latter go back through the maps to source offsets, and those that do not lie
within a span of the same kind found in the source are added to these.

Kinds are email, ip, card and phone. Spans are code points of the source, end exclusive.

Defined cases: a null text is an empty one and has no spans; texts of any length are scanned whole in linear time;
repeated rows and rows with a null id are scanned like others; an empty table gives no rows; other columns do not
matter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[int, int]

#: Cyrillic and Greek letters that look like Latin ones, and what they look like.
LOOK_ALIKES = dict(zip("АВСЕНІЈКМОРЅТХаеосрухіјѕԁԛԝҺһΑΒΕΖΗΙΚΜΝΟΡΤΥΧοανι", "ABCEHIJKMOPSTXaeocpyxijsdqwHhABEZHIKMNOPTYXoavi"))
#: Full-width forms, digits of other scripts, and other signs for the at sign and the full stop.
PLAIN = {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)}
PLAIN |= {chr(zero + d): str(d) for zero in (0x0660, 0x06F0, 0x0966, 0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6) for d in range(10)}
PLAIN |= dict(zip("﹫․。·‐‑‒–−", "@...-----"))
#: Invisible characters: soft hyphen, zero-width ones, word joiner, byte order mark.
INVISIBLE = "­​‌‍⁠﻿"
#: Spelled digits.
SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

_ODD = re.compile("[" + re.escape("".join(LOOK_ALIKES) + "".join(PLAIN) + INVISIBLE) + "]")
_LOOK_ALIKE = re.compile("[" + re.escape("".join(LOOK_ALIKES)) + "]")
_WORD = re.compile(r"\S+")
_HIDDEN = re.compile("[" + INVISIBLE + "]+")
_TO_PLAIN = str.maketrans(PLAIN)
_TO_LATIN = str.maketrans(LOOK_ALIKES)
_DIGIT = "(?:" + "|".join(SPELLED) + ")"
_DIGIT_RUN = re.compile(rf"(?<![^\W_]){_DIGIT}(?:[ \t-]+{_DIGIT})*(?![^\W_])", re.I)
_DIGIT_WORD = re.compile(_DIGIT, re.I)
_LETTER_DIGIT = re.compile(r"(?<=[0-9])[OolI](?=[0-9])")
# A run of blanks is tried from its start only, or not at all.
_BLANKS = r"(?:(?<!\s)\s*+|)"
_BRACKETED_AT = re.compile(_BLANKS + r"(?:\(\s*(?:at|@)\s*\)|\[\s*(?:at|@)\s*\]|\{\s*(?:at|@)\s*\}|<\s*(?:at|@)\s*>)\s*", re.I)
_BRACKETED_DOT = re.compile(_BLANKS + r"(?:\(\s*(?:dot|\.)\s*\)|\[\s*(?:dot|\.)\s*\]|\{\s*(?:dot|\.)\s*\}|<\s*(?:dot|\.)\s*>)\s*", re.I)
#: Last parts of domains that a spoken address may have; none of them is a common word.
SPOKEN_ENDS = "com org net edu gov mil int info biz dev app io co uk de fr es eu ch at nl se pl jp cn ru br ca au nz za kr tv cc example test invalid"
#: A spoken address has both words: "name at host dot end"; the name may have spoken dots, too.
_SPOKEN = re.compile(
    r"(?<![^\s(<\[\"':,;])[A-Za-z0-9._%+-]+(?P<before>(?:[ \t]+dot[ \t]+[A-Za-z0-9._%+-]+)*)(?P<at>[ \t]+at[ \t]+|@)"
    r"(?P<host>[A-Za-z0-9-]+(?:(?:[ \t]+dot[ \t]+|\.)[A-Za-z0-9-]+)*(?:[ \t]+dot[ \t]+|\.)(?:" + "|".join(SPOKEN_ENDS.split()) + r"))(?![^\W_])",
    re.I,
)
_SPOKEN_DOT = re.compile(r"(?<![ \t])[ \t]++dot[ \t]+", re.I)
_DIGIT_DOT = re.compile(r"(?<=[0-9])[ \t]+(?:dot|point)[ \t]+(?=[0-9])", re.I)
_PLUS = re.compile(r"(?<![^\s(:,;])plus[ \t]+(?=[0-9])", re.I)

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Possessive digits and the look-behind only save time on long digit runs; the matches are the same.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def emails(text: str) -> Iterable[Span]:
    """Leftmost matches of local part, at sign and domain; walking back from each at sign keeps this linear."""
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        else:
            done = at + 1
        at = text.find("@", done)


def detect(text: str) -> dict[str, list[Span]]:
    """The spans of each kind in a text as it stands."""
    found: dict[str, list[Span]] = {"email": list(emails(text)), "ip": [], "card": [], "phone": []}
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (g.lstrip("0") for g in m.groups()))]
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 16:
            digits = _NOT_DIGIT.sub("", match[0])
            if 16 <= len(digits) <= 19 and luhn(digits):
                found["card"].append(match.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


class Rewritten:
    """A text and the map of its offsets to the source's. Each rewriting adds a map; they are applied last to first."""

    def __init__(self, text: str):
        self.text = text
        self.maps: list[tuple[list[int], list[int], list[int], list[int]]] = []

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Apply edits (start, end, new text), in order and without overlap."""
        edits = [e for e in edits if self.text[e[0] : e[1]] != e[2]]
        if not edits:
            return
        parts, at, size = [], 0, 0
        new_start, new_end, old_start, old_end = [], [], [], []
        for start, end, new in edits:
            parts += [self.text[at:start], new]
            size += start - at
            new_start.append(size), new_end.append(size + len(new)), old_start.append(start), old_end.append(end)
            size, at = size + len(new), end
        self.text = "".join([*parts, self.text[at:]])
        self.maps.append((new_start, new_end, old_start, old_end))

    def each(self, pattern: re.Pattern, new: Callable[[re.Match], str]) -> None:
        self.replace([(*m.span(), new(m)) for m in pattern.finditer(self.text)])

    def source(self, start: int, end: int) -> Span:
        """The source span of a non-empty span of this text: an edit that it touches is in it as a whole."""
        for new_start, new_end, old_start, old_end in reversed(self.maps):
            first, last = bisect_right(new_start, start) - 1, bisect_right(new_start, end - 1) - 1
            if first >= 0:
                start = old_start[first] if start < new_end[first] else start - new_end[first] + old_end[first]
            if last >= 0:
                end = old_end[last] if end <= new_end[last] else end - new_end[last] + old_end[last]
        return start, end


def fold(text: Rewritten) -> None:
    """Look-alikes in words that also have ASCII letters or signs of an address, other forms of ASCII, invisible characters."""
    if text.text.isascii() or not _ODD.search(text.text):
        return
    text.each(_HIDDEN, lambda m: "")
    plain = text.text.translate(_TO_PLAIN)
    mixed = lambda w: any(c.isascii() and (c.isalpha() or c == "@") for c in w)
    if _LOOK_ALIKE.search(plain):
        plain = _WORD.sub(lambda m: m[0].translate(_TO_LATIN) if _LOOK_ALIKE.search(m[0]) and mixed(m[0]) else m[0], plain)
    text.text = plain  # character by character, so offsets stay


def digits(text: Rewritten) -> None:
    """Runs of spelled digits become digits without anything between them; O, o, l, I between digits become digits."""
    text.each(_DIGIT_RUN, lambda m: "".join(SPELLED[w.lower()] for w in _DIGIT_WORD.findall(m[0])))
    text.each(_LETTER_DIGIT, lambda m: "0" if m[0] in "Oo" else "1")


def signs(text: Rewritten) -> None:
    text.each(_BRACKETED_AT, lambda m: "@")
    text.each(_BRACKETED_DOT, lambda m: ".")
    edits = []
    for m in _SPOKEN.finditer(text.text):
        if m["at"] == "@" or _SPOKEN_DOT.search(m["host"]):
            dots = lambda part: [(m.start(part) + d.start(), m.start(part) + d.end(), ".") for d in _SPOKEN_DOT.finditer(m[part])]  # noqa: E731, B023
            edits += [*dots("before"), (*m.span("at"), "@"), *dots("host")]
    text.replace(edits)
    text.each(_DIGIT_DOT, lambda m: ".")
    text.each(_PLUS, lambda m: "+")


def normalised(text: str) -> Rewritten:
    result = Rewritten(text)
    for step in (fold, digits, signs):
        step(result)
    return result


def find_spans(text: str | None) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """The base spans of a text, and all spans with those that the rewriting reveals; sorted within their kinds."""
    text = text or ""
    base = detect(text)
    rewritten = normalised(text)
    if rewritten.text == text:
        return base, base
    every = {}
    for kind, spans in detect(rewritten.text).items():
        own, starts = base[kind], [s for s, _ in base[kind]]
        added = []
        for span in spans:
            start, end = rewritten.source(*span)
            i = bisect_right(starts, start) - 1
            # A letter beyond ASCII right before an address: it was cut out of a word of another script.
            inside_word = kind == "email" and start > 0 and text[start - 1].isalpha() and not text[start - 1].isascii()
            if not inside_word and (i < 0 or own[i][1] < end):
                added.append((start, end))
        every[kind] = sorted({*own, *added})
    return base, every


def joined(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind in KINDS for start, end in spans[kind])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base string, spans string"


def _found(texts: pd.Series) -> pd.DataFrame:
    rows = []
    for text in texts:
        base, every = find_spans(text)
        rows.append([*(len(base[k]) for k in KINDS), joined(base), joined(every)])
    return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base", "spans"])


def find(docs: DataFrame) -> DataFrame:
    """Per row: ``_doc`` (the whole row) and ``found``: counts of base spans by kind, base spans, all spans."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    return rows.select("_doc", F.pandas_udf(_found, FOUND)(F.col("_doc.text")).alias("found"))


def digest(found: DataFrame) -> DataFrame:
    counts = (F.col(f"found.n_{kind}").alias(f"n_{kind}") for kind in KINDS)
    return found.select(F.col("_doc.doc_id").alias("doc_id"), *counts, F.sha2("found.base", 256).alias("base_sha256"), F.col("found.spans").alias("spans"))


def masked(text: str, mask: str = "*") -> str:
    """A text with every span masked, its length and all other characters kept."""
    letters = list(text)
    for spans in find_spans(text)[1].values():
        for start, end in spans:
            letters[start:end] = mask * (end - start)
    return "".join(letters)
