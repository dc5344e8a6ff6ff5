"""Quality scores by a byte-level convolutional network in numpy.

A text is its UTF-8 bytes, cut into chunks of ``CHUNK`` bytes that overlap by ``OVERLAP`` and cover all of it. Each
byte has a learned vector; learned filters over 8 bytes, every 4 bytes, look at a chunk and keep their strongest
response. A document's features are the largest and the mean response of every filter over its chunks, combined into
one probability by a logistic layer. All of it is trained together by back-propagation on a bounded sample of labelled
documents; scoring runs in batches of chunks, so memory does not grow with the length of a text.

Defined cases: a null or empty text is one chunk of padding and scored as such; labels that are null, contradictory or
without a document are not learned from; without labels of both kinds every score is the share of label 1; rows with a
null id are scored and never held out; repeated rows are scored each; an empty table gives no rows; other columns are
never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import held_out, sample

#: Bounds of the training sample: documents of each label, and the longest text drawn (code points).
SAMPLE_ROWS, SAMPLE_CHARS = 800, 20_000
FOLDS, OUT = 3, 1
THRESHOLD = 0.5
CHUNK, OVERLAP = 512, 64
STRIDE, DIM, FILTERS = 4, 8, 24
BATCH_CHUNKS = 512


def chunks(text: str | None) -> np.ndarray:
    """All bytes of a text as overlapping rows of ``CHUNK`` byte codes; padding is byte 0."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, -(-(len(data) - OVERLAP) // (CHUNK - OVERLAP)))
    padded = np.zeros((n - 1) * (CHUNK - OVERLAP) + CHUNK, np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[:: CHUNK - OVERLAP]


@dataclass
class Network:
    """``embedding`` 256 x DIM; ``left`` and ``right``, the halves of the filters, 4 DIM x FILTERS; logistic ``mix`` and ``bias``."""

    embedding: np.ndarray
    left: np.ndarray
    right: np.ndarray
    offset: np.ndarray
    mix: np.ndarray
    bias: np.ndarray

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Per chunk, position and filter. Neighbouring windows share halves, so each 4 bytes are multiplied once."""
        blocks = self.embedding[rows].reshape(len(rows) * (CHUNK // STRIDE), STRIDE * DIM)
        both = blocks @ np.concatenate([self.left, self.right], axis=1)
        both = both.reshape(len(rows), CHUNK // STRIDE, 2 * FILTERS)
        return both[:, :-1, :FILTERS] + both[:, 1:, FILTERS:]

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.responses(rows).max(axis=1) + self.offset, 0)

    def score_all(self, texts: list[str | None]) -> np.ndarray:
        """Documents are scored in batches of chunks; a batch may hold many short texts or a part of a long one."""
        best = np.zeros((len(texts), FILTERS), np.float32)
        total, count = np.zeros((len(texts), FILTERS)), np.zeros(len(texts))

        def run(parts: list[tuple[int, np.ndarray]]) -> None:
            result, at = self.pooled(np.concatenate([p for _, p in parts])), 0
            for i, part in parts:
                own = result[at : at + len(part)]
                best[i] = np.maximum(best[i], own.max(axis=0))
                total[i] += own.sum(axis=0)
                count[i] += len(own)
                at += len(own)

        parts, size = [], 0
        for i, text in enumerate(texts):
            rows = chunks(text)
            for at in range(0, len(rows), BATCH_CHUNKS):
                parts.append((i, rows[at : at + BATCH_CHUNKS]))
                size += len(parts[-1][1])
                if size >= BATCH_CHUNKS:
                    run(parts)
                    parts, size = [], 0
        if parts:
            run(parts)
        features = np.concatenate([best, total / np.maximum(count, 1)[:, None]], axis=1)
        return 1 / (1 + np.exp(-np.clip(features @ self.mix + self.bias[0], -50, 50)))


def fit(texts: list[str], labels: list[int], share: float, rounds: int = 14, rate: float = 0.004, batch: int = 32, seed: int = 10) -> Network:
    """Train on a sample; ``share`` is the share of label 1 outside the sample, to which the bias is set back."""
    rng = np.random.default_rng(seed)
    draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    width = STRIDE * DIM
    net = Network(draw(0.5, 256, DIM), draw(0.18, width, FILTERS), draw(0.18, width, FILTERS), np.zeros(FILTERS, np.float32), draw(0.1, 2 * FILTERS), np.zeros(1, np.float32))
    y = np.array(labels, np.float32)
    share = min(max(share, 1e-3), 1 - 1e-3)
    if not 0 < y.sum() < len(y):
        net.mix[:], net.bias[:] = 0, np.log(share / (1 - share))
        return net
    cut = [chunks(t) for t in texts]
    parameters = [net.embedding, net.left, net.right, net.offset, net.mix, net.bias]
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in parameters]
    turn, filters = 0, np.arange(FILTERS)
    for epoch in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(order), batch):
            turn += 1
            chosen = order[at : at + batch]
            rows = np.concatenate([cut[i] for i in chosen])
            sizes = np.array([len(cut[i]) for i in chosen])
            first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            where, peak = np.empty((len(rows), FILTERS), np.int64), np.empty((len(rows), FILTERS), np.float32)
            for part in range(0, len(rows), BATCH_CHUNKS):
                response = net.responses(rows[part : part + BATCH_CHUNKS])
                where[part : part + BATCH_CHUNKS] = spot = response.argmax(axis=1)
                peak[part : part + BATCH_CHUNKS] = np.take_along_axis(response, spot[:, None, :], 1)[:, 0]
            active = peak + net.offset > 0
            pooled = np.where(active, peak + net.offset, 0)
            best, mean = np.maximum.reduceat(pooled, first), np.add.reduceat(pooled, first) / sizes[:, None]
            features = np.concatenate([best, mean], axis=1)
            p = 1 / (1 + np.exp(-np.clip(features @ net.mix + net.bias[0], -50, 50)))
            error = (p - y[chosen]) / len(chosen)
            # Back through the mean, the maximum over chunks, and the maximum over positions.
            owner = np.repeat(np.arange(len(chosen)), sizes)
            push = (error / sizes)[owner, None] * net.mix[FILTERS:]
            is_best = pooled == best[owner]
            push = push + is_best / np.maximum(np.add.reduceat(is_best, first)[owner], 1) * error[owner, None] * net.mix[:FILTERS]
            push = (push * active).astype(np.float32)
            bytes_at = (where * STRIDE)[:, :, None] + np.arange(2 * STRIDE)
            seen = rows[np.arange(len(rows))[:, None, None], bytes_at]
            vectors = net.embedding[seen].reshape(len(rows), FILTERS, 2 * width)
            slope = np.einsum("cf,cfw->wf", push, vectors)
            back = push[:, :, None] * np.concatenate([net.left, net.right]).T[None, :, :]
            grad = np.zeros((256, DIM), np.float32)
            flat, back = seen.ravel(), back.reshape(-1, DIM)
            for d in range(DIM):
                grad[:, d] = np.bincount(flat, back[:, d], 256)
            steps = [grad, slope[:width], slope[width:], push.sum(axis=0), features.T @ error + 1e-4 * net.mix, np.array([error.sum()])]
            pace = rate * (1 - 0.9 * epoch / rounds)
            for value, step, moments in zip(parameters, steps, state):
                moments[0] = 0.9 * moments[0] + 0.1 * step
                moments[1] = 0.999 * moments[1] + 0.001 * step**2
                value -= (pace * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.999**turn)) + 1e-8)).astype(np.float32)
    drawn = float(y.mean())
    net.bias += np.float32(np.log(share / (1 - share)) - np.log(drawn / (1 - drawn)))
    return net


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Network:
    return fit(*sample(docs, labels, "quality", FOLDS, OUT, rows, chars))


def score_column(net: Network, text: Column) -> Column:
    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(net.score_all(list(texts)), dtype="float64")

    return scores(text)


def score(docs: DataFrame, labels: DataFrame, **bounds) -> DataFrame:
    """Per row: ``_doc`` (the whole row), held_out, score and predicted (1: good)."""
    net = train(docs, labels, **bounds)
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    rows = rows.select("_doc", held_out(F.col("_doc.doc_id"), FOLDS, OUT).alias("held_out"), score_column(net, F.col("_doc.text")).alias("score"))
    return rows.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
