"""Toxicity scores: bags of character n-grams, embedded, averaged and put through a linear softmax.

Every word lends its n-grams of 3 to 6 bytes, word ends included, hashed into one embedding table, so a misspelling
shares most vectors with the word it disguises. The bag is a window of ``WINDOW`` words; windows overlap by half and
cover the whole text, and a document is as toxic as its worst window: a few words in a long text are not averaged
away. Embeddings and softmax are trained jointly by gradient descent in numpy on a bounded sample of labelled
documents, where the worst window of each document carries the gradient.

As the softmax is linear, an n-gram adds the same number wherever it stands; scoring reads it from one table of
2^17 floats that is sent to the tasks.

Defined cases: a text without words (null, empty, signs only) gets the score of an average of nothing, the bias alone;
labels that are null, contradictory or without a document are not learned from; without labels of both kinds every score
is the share of label 1; rows with a null id are scored and never held out; repeated rows are scored each; an empty
table gives no rows; other columns are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import held_out, sample
from .tables import WORD_BYTES

#: Bounds of the training sample: documents of each label, and the longest text drawn (code points).
SAMPLE_ROWS, SAMPLE_CHARS = 800, 8_000
FOLDS, OUT = 4, 2
THRESHOLD = 0.3
WINDOW = 6
SIZES = (3, 4, 5, 6)
TABLE_BITS, DIM = 17, 8
#: N-grams of fewer texts of the sample are not learned; the floor under which a gradient counts as small.
MIN_TEXTS, EPSILON = 5, 1e-5
BATCH_BYTES = 1 << 18


def words_of(text: str | None) -> np.ndarray:
    """The bytes of a text's words with one blank before each, and blanks behind; one blank if there are none."""
    data = b" ".join((text or "").encode("utf-8", "surrogatepass").translate(WORD_BYTES).split())
    return np.frombuffer((b" " + data if data else b"") + b" " * SIZES[-1], np.uint8)


def codes(octets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: the table row of the n-gram that starts at each byte, and whether it is one.

    Only its first and its last byte may be a blank.
    """
    n = len(octets) - SIZES[-1]
    inner = np.concatenate([[0], np.cumsum(octets == 32, dtype=np.int32)])
    code = np.zeros(n, np.uint64)
    for j in range(SIZES[-1]):
        code = code * np.uint64(257) + octets[j : j + n] + np.uint64(1)
        if j + 1 in SIZES:
            rows = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)
            yield rows.astype(np.int32), inner[j : j + n] == inner[1 : n + 1]


def word_starts(octets: np.ndarray) -> np.ndarray:
    """Where the blank before each word is, then the end."""
    n = len(octets) - SIZES[-1]
    blank = octets == 32
    return np.append(np.flatnonzero(blank[:n] & ~blank[1 : n + 1]), n)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of a text in order of their start, and where each word's n-grams begin (then the end)."""
    octets = words_of(text)
    rows, valid = zip(*codes(octets))
    rows, valid = np.stack(rows, axis=1), np.stack(valid, axis=1)
    return rows[valid], np.concatenate([[0], np.cumsum(valid.sum(axis=1))])[word_starts(octets)]


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each window's n-grams."""
    n_words = len(bounds) - 1
    first = np.arange(0, max(1, n_words - WINDOW // 2), WINDOW // 2)
    return bounds[first], bounds[np.minimum(first + WINDOW, n_words)]


@dataclass
class Model:
    """``weight``: what each n-gram adds to the log odds; ``bias``: the log odds of an empty bag."""

    weight: np.ndarray
    bias: float

    def score_all(self, texts: list[str | None]) -> np.ndarray:
        """Scores of many texts: n-grams are looked up for about ``BATCH_BYTES`` at a time, a longer text by itself."""
        result, part, size = [], [], 0
        for text in texts:
            part.append(words_of(text))
            size += len(part[-1])
            if size >= BATCH_BYTES:
                result.append(self._score(part))
                part, size = [], 0
        if part:
            result.append(self._score(part))
        return np.concatenate(result) if result else np.zeros(0)

    def _score(self, parts: list[np.ndarray]) -> np.ndarray:
        octets = np.concatenate(parts)  # each part ends in blanks, so no n-gram reaches into the next
        total, count = np.zeros(len(octets) + 1), np.zeros(len(octets) + 1, np.int32)
        for rows, valid in codes(octets):
            total[1 : len(rows) + 1] += self.weight[rows] * valid
            count[1 : len(rows) + 1] += valid
        total, count = np.cumsum(total), np.cumsum(count)
        begin, end, groups = [], [], []
        at = 0
        starts = word_starts(octets)
        bounds = np.cumsum([0] + [len(p) for p in parts])
        first = np.searchsorted(starts[:-1], bounds)
        for i, (a, b) in enumerate(zip(first[:-1], first[1:])):
            x, y = windows(np.append(starts[a:b], bounds[i + 1] - SIZES[-1]))
            begin.append(x), end.append(y), groups.append(at)
            at += len(x)
        begin, end = np.concatenate(begin), np.concatenate(end)
        odds = (total[end] - total[begin]) / np.maximum(count[end] - count[begin], 1)
        odds = self.bias + np.maximum.reduceat(odds, np.array(groups))
        return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))

    def score(self, text: str | None) -> float:
        return float(self.score_all([text])[0])


def _packed(part: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Some texts as one: n-grams, window begins and ends, first window of each text, text of each window."""
    offset = np.cumsum([0] + [len(bag) for bag, _, _ in part])
    groups = np.cumsum([0] + [len(begin) for _, begin, _ in part])
    begin, end = (np.concatenate([spans[i] + o for spans, o in zip(part, offset)]).astype(np.int32) for i in (1, 2))
    return np.concatenate([bag for bag, _, _ in part]), begin, end, groups, np.repeat(np.arange(len(part)), np.diff(groups))


def fit(texts: list[str], labels: list[int], share: float, rounds: int = 60, rate: float = 0.05, decay: float = 0.005, seed: int = 7) -> Model:
    """Train on a sample; ``share`` is the share of label 1 outside the sample, to which the bias is set back.

    In early rounds all windows of a document carry the gradient, in late rounds mostly its worst one: the log odds of
    a document are the soft maximum of its windows', and that sharpens from round to round. N-grams of fewer than
    ``MIN_TEXTS`` texts keep a zero vector.
    """
    y = np.array(labels, np.float64)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(2**TABLE_BITS, np.float32), float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    in_texts = np.zeros(2**TABLE_BITS, np.int64)
    parts, part, size = [], [], 0
    for i, text in enumerate(texts):
        bag, bounds = ngrams(text)
        in_texts[np.unique(bag)] += 1
        part.append((bag, *windows(bounds)))
        size += len(bag)
        if size >= BATCH_BYTES or i == len(texts) - 1:
            parts.append(_packed(part))
            part, size = [], 0
    rng = np.random.default_rng(seed)
    learned = in_texts >= MIN_TEXTS
    embedding = rng.normal(0, 0.1, (2**TABLE_BITS, DIM)) * learned[:, None]
    softmax, bias = rng.normal(0, 0.5, (DIM, 2)), np.zeros(2)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (embedding, softmax, bias)]
    for turn in range(1, rounds + 1):
        weight = embedding @ (softmax[:, 1] - softmax[:, 0])
        sharp = 1 + 7 * turn / rounds
        pull, pressure, at = np.zeros(2**TABLE_BITS), 0.0, 0
        for rows, begin, end, groups, owner in parts:
            total = np.concatenate([[0.0], np.cumsum(weight[rows])])
            count = np.maximum(end - begin, 1)
            odds = (total[end] - total[begin]) / count
            top = np.maximum.reduceat(odds, groups[:-1])
            share_of = np.exp(sharp * (odds - top[owner]))
            mass = np.add.reduceat(share_of, groups[:-1])
            soft = top + np.log(mass / np.diff(groups)) / sharp
            p = 1 / (1 + np.exp(-np.clip(soft + bias[1] - bias[0], -50, 50)))
            error = (p - y[at : at + len(p)]) / len(y)
            at += len(p)
            push = error[owner] * share_of / mass[owner] / count
            change = np.bincount(begin, push, len(rows) + 1) - np.bincount(end, push, len(rows) + 1)
            pull += np.bincount(rows, np.cumsum(change)[:-1], 2**TABLE_BITS)
            pressure += error.sum()
        pull *= learned
        slope = embedding.T @ pull
        steps = (np.outer(pull, softmax[:, 1] - softmax[:, 0]), np.stack([-slope, slope], axis=1), np.array([-pressure, pressure]))
        for value, step, moments in zip((embedding, softmax, bias), steps, state):
            moments[0] = 0.9 * moments[0] + 0.1 * step
            moments[1] = 0.999 * moments[1] + 0.001 * step**2
            value -= rate * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.999**turn)) + EPSILON)
        embedding *= 1 - decay
    weight = (embedding @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32)
    drawn = y.mean()
    share = min(max(share, 1e-3), 1 - 1e-3)
    return Model(weight, float(bias[1] - bias[0] + np.log(share / (1 - share)) - np.log(drawn / (1 - drawn))))


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    return fit(*sample(docs, labels, "toxic", FOLDS, OUT, rows, chars))


def score_column(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score_all(list(texts)), dtype="float64")

    return scores(text)


def score(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Per row: ``_doc`` (the whole row), held_out, score and predicted."""
    model = train(docs, labels, **bounds)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    rows = rows.select("_doc", held_out(F.col("_doc.doc_id"), FOLDS, OUT).alias("held_out"), score_column(model, F.col("_doc.text")).alias("score"))
    return rows.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """The documents that are not predicted toxic; columns as before."""
    return score(docs, labels, **bounds).filter("predicted = 0").select("_doc.*")
