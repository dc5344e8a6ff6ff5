"""Licence labels and scores against a version by words and recursive descent; prose behind plain tags."""

import random

import brute
import pytest

from decoylens.llm import licences

IDENTIFIERS = {
    "Zlib": "zlib", "Artistic-2.0": "artistic", "EUPL-1.2": "eupl", "CDDL-1.0": "cddl", "PSF-2.0": "psf", "Python-2.0": "psf",
    "WTFPL": "wtfpl", "AFL-3.0": "afl", "OFL-1.1": "ofl", "0BSD": "bsd", "BSD-3-Clause": "bsd", "BSL-1.0": "bsl", "CC0-1.0": "cc0",
    "MPL-2.0": "mpl", "EPL-2.0": "epl", "GFDL-1.3-only": "gfdl", "LGPL-2.1-or-later": "lgpl", "AGPL-3.0-only": "agpl", "NCSA": "ncsa",
    "PostgreSQL": "postgresql", "MS-PL": "ms-pl", "MS-RL": "ms-rl", "OSL-3.0": "osl", "UPL-1.0": "upl", "ODbL-1.0": "odbl", "X11": "mit",
    "CC-BY-4.0": "cc-by", "CC-BY-NC-ND-4.0": "cc-by-nc-nd", "SSPL-1.0": "sspl", "BUSL-1.1": "busl", "LPPL-1.3c": "lppl", "W3C": "w3c",
    "GPLv2": "gpl", "GPLv3+": "gpl", "LGPLv2.1": "lgpl", "Apache2": "apache", "BSD3": "bsd", "Apache-2.0": "apache", "Unicode-3.0": "unicode",
}


@pytest.mark.parametrize("identifier", IDENTIFIERS)
def test_known_identifiers_behind_either_tag(identifier):
    for tag in ("SPDX-License-Identifier:", "License:", "licence:"):
        found = licences.scan_text(f"{tag} {identifier}\n")
        name = IDENTIFIERS[identifier]
        assert set(found["labels"]) == {name} | notices(identifier) and found["score"] == licences.DEGREES[name]


@pytest.mark.parametrize(
    "text, labels, score",
    [
        ("MIT License: Permission is hereby granted, free of charge, to any person obtaining a copy", ["mit"], 0.95),
        ("License: The MIT License", ["mit"], 0.95),
        ("The license: it was lost", [], 0.0),
        ("License: GPLv3", ["gpl"], 0.45),
        ("License: https://example.org/MIT", [], 0.0),
        ("License: MIT/Apache-2.0", ["apache", "mit"], 0.95),
        ("License: GPL-2.0 with Classpath-exception-2.0", ["gpl"], 0.725),
        ("License: MIT with attribution", ["mit"], 0.95),
        ("License: MIT and whatever follows", ["mit"], 0.95),
        ("License: (MIT or something", ["mit"], 0.95),
        ("SPDX-License-Identifier: House-Rules", ["other"], 0.2),
        ("SPDX-License-Identifier: MIT/House-Rules", ["mit", "other"], 0.95),
        ("License:", [], 0.0),
        ("License: License: MIT", ["mit"], 0.95),
        ("License: " + "word " * 100_000, [], 0.0),
        ("License: " + "(" * 100_000, [], 0.0),
    ],
)
def test_prose_behind_a_plain_tag(text, labels, score):
    found = licences.scan_text(text)
    assert (found["labels"], found["score"]) == (labels, pytest.approx(score))


def expression(rng, depth):
    """A random well-formed expression as text, with its degree and families by its own structure."""
    if depth == 0 or rng.random() < 0.3:
        name = rng.choice([*IDENTIFIERS])
        kind = IDENTIFIERS[name]
        if rng.random() < 0.2:
            return f"{name} {rng.choice(['with', 'WITH'])} Some-exception", (1 + licences.DEGREES[kind]) / 2, {kind}
        return name, licences.DEGREES[kind], {kind}
    sides = [expression(rng, depth - 1) for _ in range(2)]
    word, take = rng.choice([("and", min), ("OR", max), ("or", max), ("AND", min), ("/", max)])
    text = word.join(f" ({t}) " for t, _, _ in sides).strip()
    return text, take(d for _, d, _ in sides), sides[0][2] | sides[1][2]


def flat(rng):
    """Operands joined without brackets: ``and`` binds before ``or``."""
    groups = [[rng.choice([*IDENTIFIERS]) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 4))]
    names = [[IDENTIFIERS[x] for x in g] for g in groups]
    return " or ".join(" and ".join(g) for g in groups), max(min(licences.DEGREES[n] for n in g) for g in names), {n for g in names for n in g}


def notices(text):
    own = brute.words(text)
    every = licences.NOTICES | licences.BASE_PHRASES
    return {label for phrase, label in every.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()}


def test_labels_and_scores_of_composed_texts():
    rng = random.Random(5)
    prose = ["some words", "all rights reserved", "the MIT license applies", "cc by-nc sa", "GNU lesser\ngeneral public, license", "isc", "license", "é漢 text"]
    for _ in range(1500):
        parts, found = [], []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                text, degree, names = (expression(rng, 3) if rng.random() < 0.6 else flat(rng))
                found.append((degree, names))
                parts.append(f"{rng.choice(['License: ', 'SPDX-License-Identifier:', '# license-expression: ', 'Licence:'])}{text}\n")
            else:
                parts.append(rng.choice(prose) + "\n")
        text = "".join(parts)
        own = notices(text)
        got = licences.scan_text(text)
        assert got["labels"] == sorted(own.union(*(n for _, n in found))), text
        degrees = [d for d, _ in found] or [licences.DEGREES[n] for n in own]
        assert got["score"] == pytest.approx(min(degrees, default=0.0)), text
        assert got["n_words"] == len(brute.words(text))
