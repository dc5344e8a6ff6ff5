"""Licence scan: an Aho-Corasick automaton finds notice phrases and identifier tags, a shunting-yard parser evaluates
the licence expressions that follow the tags.

Phrases are matched on words: A-Z are lower-cased and everything between words is one blank, so line breaks and
punctuation do not hide a notice. Tags are matched on the text itself, since expressions need their brackets, dashes
and dots. A whole text is scanned in one pass of each automaton.

An expression is operands joined by ``and``, ``or`` (also ``/``) and ``with`` (binding: with, and, or; brackets allowed)
and ends at the line's end or where the grammar ends. Behind the tags of SPDX (``STRICT_TAGS``) any word is an operand.
Behind ``license:`` prose is as likely, so there an operand must be a known identifier or a usual short form (GPLv3,
Apache2, BSD3), and an exception behind ``with`` must have a dash; the first other word ends the expression. ``score`` says how freely the text may be used: each licence family has a
degree (``DEGREES``), ``and`` takes the lower, ``or`` the higher, and ``with`` an exception half the way up to 1. Over
a document the lowest of its expressions, or of its notices where it has no expression; 0 where nothing was found.

Defined cases: a null or empty text has no words and no labels, and score 0; an unknown operand behind a
strict tag is labelled ``other`` and has degree 0.2; a tag without an operand behind it adds nothing; repeated rows and rows with a
null id are scanned like others; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .tables import WORD_BYTES

#: The phrases that count as base places.
BASE_PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Further notice phrases, as words.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu library general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "licensed under the apache license": "apache",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "isc license": "isc",
    "boost software license": "bsl",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc0": "cc0",
    "all rights reserved": "proprietary",
}
#: Tags before an expression, lower case. A tag that ends in a plain one counts as itself.
STRICT_TAGS = ("spdx-license-identifier:", "license-expression:")
PLAIN_TAGS = ("license:", "licence:")
#: How freely a family's works may be used, from 0 to 1.
DEGREES = {
    "unlicense": 1.0,
    "cc0": 1.0,
    "wtfpl": 1.0,
    "pddl": 1.0,
    "isc": 0.95,
    "mit": 0.95,
    "bsd": 0.95,
    "bsl": 0.95,
    "zlib": 0.95,
    "libpng": 0.95,
    "ncsa": 0.95,
    "postgresql": 0.95,
    "upl": 0.95,
    "blueoak": 0.95,
    "hpnd": 0.95,
    "w3c": 0.95,
    "curl": 0.95,
    "unicode": 0.95,
    "icu": 0.95,
    "apache": 0.9,
    "psf": 0.9,
    "ecl": 0.9,
    "mulanpsl": 0.9,
    "ruby": 0.9,
    "openssl": 0.9,
    "afl": 0.85,
    "cc-by": 0.85,
    "odc-by": 0.85,
    "ofl": 0.8,
    "ms-pl": 0.8,
    "mpl": 0.7,
    "artistic": 0.7,
    "lppl": 0.7,
    "epl": 0.65,
    "cpl": 0.65,
    "cddl": 0.65,
    "lgpl": 0.6,
    "ms-rl": 0.6,
    "apsl": 0.6,
    "vim": 0.6,
    "cc-by-sa": 0.55,
    "eupl": 0.55,
    "odbl": 0.55,
    "gfdl": 0.5,
    "gpl": 0.45,
    "osl": 0.45,
    "cecill": 0.45,
    "qpl": 0.4,
    "agpl": 0.35,
    "cc-by-nd": 0.3,
    "cc-by-nc": 0.25,
    "cc-by-nc-sa": 0.2,
    "sspl": 0.2,
    "busl": 0.2,
    "elastic": 0.2,
    "other": 0.2,
    "cc-by-nc-nd": 0.15,
    "proprietary": 0.0,
}
#: Identifiers whose family has another name.
ALIASES = {
    "0bsd": "bsd",
    "expat": "mit",
    "x11": "mit",
    "python": "psf",
    "psfl": "psf",
    "boost": "bsl",
    "mozilla": "mpl",
    "ccby": "cc-by",
    "public-domain": "unlicense",
}
BINDING = {"or": 1, "and": 2, "with": 3}
_VERSION = re.compile(r"v?[0-9]+(\.[0-9]+)*$")
_TOKEN = re.compile(r"[ \t]*([()/]|[A-Za-z0-9](?:[A-Za-z0-9.+-]*[A-Za-z0-9+])?)")


def family(identifier: str) -> str:
    """The family of a licence identifier: its longest known prefix of dash-separated parts, of which the last may end
    in a version (GPLv3, LGPLv2.1, Apache2)."""
    parts = identifier.lower().rstrip("+").split("-")
    for n in range(len(parts), 0, -1):
        name = "-".join(parts[:n])
        for form in (name, _VERSION.sub("", name)):
            form = ALIASES.get(form, form)
            if form in DEGREES and form != "other":
                return form
    return "other"


def tokens(text: str, at: int) -> Iterator[str]:
    while match := _TOKEN.match(text, at):
        yield match[1]
        at = match.end()


def postfix(stream: Iterator[str], strict: bool = True) -> list[str]:
    """Shunting-yard: operands and operators in evaluation order, up to where the grammar ends; operators lower case.

    Unless ``strict``, an operand that names no known licence ends the expression, as prose does.
    """
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in stream:
        low = "or" if token == "/" else token.lower()
        if operand_next:
            if token == "(":
                held.append(token)
            elif token == ")" or low in BINDING:
                break
            elif not strict and ("-" not in token if held and held[-1] == "with" else family(token) == "other"):
                break
            else:
                out.append(token)
                operand_next = False
        elif token == ")":
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break
            held.pop()
        elif low in BINDING:
            while held and held[-1] != "(" and BINDING[held[-1]] >= BINDING[low]:
                out.append(held.pop())
            held.append(low)
            operand_next = True
        else:
            break
    while operand_next and held:
        operand_next = held.pop() == "("  # open brackets, then the operator with nothing behind it
    return out + [x for x in reversed(held) if x != "("]


def evaluate(expression: list[str]) -> tuple[float, set[str]]:
    """Degree and families of a postfix expression; the operand after ``with`` is an exception, not a licence."""
    stack: list[tuple[float, set[str]]] = []
    for token in expression:
        if token not in BINDING:
            name = family(token)
            stack.append((DEGREES[name], {name}))
            continue
        (b, names_b), (a, names_a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(((1 + a) / 2, names_a))
        else:
            stack.append(((min if token == "and" else max)(a, b), names_a | names_b))
    return stack[-1] if stack else (0.0, set())


@cache
def automata() -> tuple:
    """The automaton of phrases (values: label, words of a base phrase or 0) and that of tags; once per worker."""
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (NOTICES | BASE_PHRASES).items():
        phrases.add_word(f" {phrase} ", (label, phrase in BASE_PHRASES, len(phrase) + 1))
    for tag in STRICT_TAGS + PLAIN_TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def scan_text(text: str | None) -> dict:
    """All findings of one text. Strings are handled as latin-1 views of their UTF-8 bytes, which keep every offset."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.translate(WORD_BYTES).split()
    phrases, tags = automata()
    joined = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = [(end - size, label, base) for end, (label, base, size) in phrases.iter(joined)] if words else []
    starts: list[int] = []
    if any(base for _, _, base in found):
        at = 1
        for word in words:
            starts.append(at)
            at += len(word) + 1
    places = sorted(bisect_right(starts, at + 1) - 1 for at, _, base in found if base)
    plain = data.decode("latin-1")
    expressions = []
    strict: dict[int, bool] = {}
    for end, tag in tags.iter(data.lower().decode("latin-1")):
        strict[end] = strict.get(end, False) or tag in STRICT_TAGS  # one tag may end another one
    for end, any_word in strict.items():
        expressions.append(evaluate(postfix(tokens(plain, end + 1), any_word)))
    expressions = [e for e in expressions if e[1]]
    notices = {label for _, label, _ in found}
    labels = notices.union(*(names for _, names in expressions))
    degrees = [degree for degree, _ in expressions] or [DEGREES[n] for n in notices]
    return {
        "n_words": len(words),
        "places": places,
        "base_labels": sorted({label for _, label, base in found if base}),
        "labels": sorted(labels),
        "score": float(min(degrees, default=0.0)),
    }


FINDINGS = "n_words long, places array<long>, base_labels array<string>, labels array<string>, score double"


def _findings(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([scan_text(t) for t in texts], columns=["n_words", "places", "base_labels", "labels", "score"])


def scan(docs: DataFrame) -> DataFrame:
    """Per row: ``_doc`` (the whole row) and ``found``: n_words, places of base phrases, base labels, labels, score."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    return rows.select("_doc", F.pandas_udf(_findings, FINDINGS)(F.col("_doc.text")).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    places = F.col("found.places")
    return scanned.select(
        F.col("_doc.doc_id").alias("doc_id"),
        F.col("found.n_words").alias("n_words"),
        F.size(places).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        F.array_join("found.base_labels", ",").alias("base_labels"),
        F.array_join("found.labels", ",").alias("labels"),
        F.col("found.score").alias("score"),
    )
