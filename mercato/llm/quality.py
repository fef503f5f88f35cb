"""Quality by supervised subword embeddings.

Each word and each run of three to five bytes of it, with the blanks around a word as marks, has a
learned vector under its hash. Two marks have vectors too: one stands for each word that
repeats the one before it, one for each run of three words that the text has had already. A document is the average of its vectors, and a softmax of it
gives the classes. Vectors and softmax are trained together by stochastic gradient descent
in numpy. Since the average and the softmax's input are linear, scoring folds each vector into
one number first.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from mercato.llm import training
from mercato.llm.training import sigmoid

BITS = 18
BUCKETS = 1 << BITS
WIDTH = 10
SIZES = (3, 4, 5)
#: Labelled documents that are fitted on, at most about.
SAMPLE = 8000
#: Bytes whose runs are hashed at a time.
CHUNK = 1 << 20
#: The buckets of the two marks.
AGAIN, SEEN = BUCKETS - 1, BUCKETS - 2
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Embeddings:
    vectors: np.ndarray
    softmax: np.ndarray
    bias: np.ndarray


def _runs(data: np.ndarray, size: int) -> np.ndarray:
    """Buckets of the byte runs of one size without a blank inside."""
    count = len(data) - size + 1
    if count <= 0:
        return np.zeros(0, np.int64)
    blank = _BLANK[data]
    wide = np.where(blank, 32, data).astype(np.uint64)
    value = wide[:count].copy()
    keep = np.ones(count, bool)
    for k in range(1, size):
        value |= wide[k : k + count] << np.uint64(8 * k)
        if k < size - 1:
            keep &= ~blank[k : k + count]
    value = (value[keep] + np.uint64(size << 56)) * _MIX
    return (value >> np.uint64(64 - BITS)).astype(np.int64)


def buckets(text: bytes):
    """The buckets of a text's words and byte runs with repeats, in arrays of bounded size."""
    if not text.strip():
        return
    words = np.array([crc32(w) for w in text.split()], np.uint64)
    yield (words & np.uint64(BUCKETS - 1)).astype(np.int64)
    yield np.full(int((words[1:] == words[:-1]).sum()), AGAIN)
    if len(words) > 2:
        three = (words[:-2] * _MIX + words[1:-1]) * _MIX + words[2:]
        yield np.full(len(three) - len(np.unique(three)), SEEN)
    marked = b" " + text + b" "
    for start in range(0, len(marked), CHUNK):
        for size in SIZES:
            data = np.frombuffer(marked[start : start + CHUNK + size - 1], np.uint8)
            yield _runs(data, size)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    found = list(buckets(text))
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    ids, counts = np.unique(np.concatenate(found), return_counts=True)
    return ids.astype(np.int32), counts.astype(np.int32)


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 4, rate: float = 2.0, seed: int = 5) -> Embeddings:
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1.0 / WIDTH, 1.0 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    softmax, bias = np.zeros((2, WIDTH), np.float32), np.zeros(2, np.float32)
    prior = (float(y.sum()) + 0.5) / (len(y) + 1.0)
    bias[:] = np.log([1.0 - prior, prior])
    steps, done = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for at in rng.permutation(len(rows)):
            ids, counts = rows[at]
            lr = rate * (1.0 - done / steps)
            done += 1
            share = (counts / max(1, counts.sum())).astype(np.float32)
            hidden = share @ vectors[ids]
            scores = softmax @ hidden + bias
            odds = np.exp(scores - scores.max())
            gradient = odds / odds.sum()
            gradient[int(y[at])] -= 1.0
            back = gradient @ softmax
            softmax -= 0.1 * lr * np.outer(gradient, hidden)
            bias -= 0.01 * lr * gradient
            # The most frequent features move by the full rate, rarer ones by their share of it.
            vectors[ids] -= lr * np.outer(share / max(float(share.max()), 1e-9) if len(share) else share, back)
    return Embeddings(vectors, softmax, bias)


def prepare(model: Embeddings):
    pull = model.vectors @ (model.softmax[1] - model.softmax[0])
    base = float(model.bias[1] - model.bias[0])

    def score(text: bytes) -> float:
        total, count = 0.0, 0
        for ids in buckets(text):
            total += float(pull[ids].sum(dtype=np.float64))
            count += len(ids)
        return float(sigmoid(base + total / max(count, 1)))

    return score


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", bound: int = SAMPLE) -> training.Scorer:
    """A scorer fitted on a sample of labelled documents that are not held out."""
    sample = training.labelled_sample(docs, labels, label, bound)
    return training.Scorer(training.fit(sample, features, train, Embeddings), prepare)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, bound: int = SAMPLE) -> DataFrame:
    """Every row's score and prediction.

    Null texts score like empty ones: by the bias. Without any label the score is a half.
    Rows are neither dropped nor merged, and other columns are not looked at.
    """
    return training.report(docs, learned(docs, labels, bound=bound), threshold)
