"""Plain, slow versions of the operators, written from their definitions alone."""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(lower(text or ""))


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def pii(text: str | None) -> dict[str, list[tuple[int, int]]]:
    text = text or ""
    only = lambda m: "".join(c for c in m[0] if c in "0123456789")
    return {
        "email": [m.span() for m in EMAIL.finditer(text)],
        "ip": [m.span() for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))],
        "card": [m.span() for m in CARD.finditer(text) if 16 <= len(only(m)) <= 19 and luhn(only(m))],
        "phone": [m.span() for m in PHONE.finditer(text) if 8 <= len(only(m)) <= 15],
    }


def contamination(text: str | None, items: dict[int, str | None], size: int) -> tuple[int, int, list[str]]:
    """Words, hit words, items."""
    own, hit, found = words(text), set(), set()
    for item, other in items.items():
        theirs = words(other)
        n = min(size, len(theirs))
        for i in range(len(theirs) - n + 1 if n else 0):
            for j in range(len(own) - n + 1):
                if own[j : j + n] == theirs[i : i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


def line_dedup(docs: list[tuple[int | None, str | None]], min_chars: int = 20, min_docs: int = 3) -> list[tuple[int | None, int, int, str]]:
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: lower(line.strip(blank))
    holders: dict[str, set] = {}
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc_id)
    last = {k: max(ids, key=lambda i: (i is not None, i or 0)) for k, ids in holders.items() if len(ids) >= min_docs}
    result = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc_id]
        result.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return result


def fingerprint(text: str | None, size: int = 3) -> int:
    own = [w for w in re.split(r"[\x20\x09-\x0D]+", lower(text or "")) if w]
    if not own:
        return 0
    grams = [" ".join(own[i : i + size]) for i in range(max(1, len(own) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids: list[int], prints: list[int], radius: int) -> list[int]:
    parent = list(range(len(ids)))

    def root(i: int) -> int:
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    smallest: dict[int, int] = {}
    for i, doc_id in enumerate(ids):
        smallest[root(i)] = min(smallest.get(root(i), doc_id), doc_id)
    return [smallest[root(i)] for i in range(len(ids))]


def nearest(ids: np.ndarray, vectors: np.ndarray, query: int, k: int) -> list[int]:
    score = vectors @ vectors[np.flatnonzero(ids == query)[0]]
    order = sorted((-s, i) for s, i in zip(score, ids) if i != query)
    return [i for _, i in order[:k]]


def tokens(texts: list[str | None]) -> list[tuple[int, int, int]]:
    """start, n_tokens, crc32 of each text in turn."""
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer, at, result = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        result.append((at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return result
