"""Toxicity by a factorization machine over hashed terms.

A text's terms are its distinct words and their first bytes, hashed to buckets.
The machine adds a weight for each term and, for each pair of terms, the product of their
vectors, so that a pair can count for more than both terms. Weights are learned
with a proximal step that sets those of uninformative terms to zero; vectors belong
to the other terms only, which keeps long texts from adding up noise.

A machine that is held back so leans to the commoner label. Its bias is therefore set by
documents that it was not fitted on, parts of the sample in turn: they show where it parts toxic
documents from clean ones.
"""

from __future__ import annotations

from dataclasses import dataclass
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from mercato.llm import training
from mercato.llm.training import sigmoid

BUCKETS = 1 << 18
RANK = 4
#: Labelled documents that are fitted on, at most about.
SAMPLE = 16000
#: Terms of fewer labelled documents are not learned.
LEAST_DOCUMENTS = 4
#: Parts of the sample; each is scored by a machine that is fitted on the others.
FOLDS = 3
#: How many times worse it is to lose a share of the clean documents than one of the toxic documents.
ALARM_COST = 10.0
#: ASCII that is not of a word, to a space; upper case to lower.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    #: Terms that have vectors, and the vectors.
    terms: np.ndarray
    vectors: np.ndarray


def term_ids(text: bytes) -> np.ndarray:
    """The buckets of a text's terms, in order, each once."""
    words = set(text.decode("utf-8", "replace").lower().encode().translate(FOLD).split())
    codes = [crc32(w) for w in words]
    codes += [crc32(p, 4) for p in {w[:4] for w in words}]
    codes += [crc32(p, 5) for p in {w[:5] for w in words}]
    return np.unique(np.array(codes, np.uint32) & np.uint32(BUCKETS - 1)).astype(np.int32)


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    ids = term_ids(text)
    return ids, np.ones(len(ids), np.int32)


def interactions(vectors: np.ndarray) -> float:
    """The sum over pairs of the products of vectors."""
    total = vectors.sum(axis=0)
    return 0.5 * float((total * total - (vectors * vectors).sum(axis=0)).sum())


def margin(machine: Machine, places: np.ndarray, ids: np.ndarray) -> float:
    """The logarithm of the odds. ``places`` gives each bucket's place among the machine's terms, or -1."""
    at = places[ids]
    at = at[at >= 0]
    linear = float(machine.weights[machine.terms[at]].sum())
    return machine.bias + linear + interactions(machine.vectors[at])


def places_of(machine: Machine) -> np.ndarray:
    places = np.full(BUCKETS, -1, np.int32)
    places[machine.terms] = np.arange(len(machine.terms))
    return places


def parting(margins: np.ndarray, y: np.ndarray) -> float:
    """The margin that best parts both labels: least share of toxic ones below it and, at ``ALARM_COST``, clean ones above.

    Of equally good ones the one closest to zero; zero if a label is missing.
    """
    toxic, clean = np.sort(margins[y > 0]), np.sort(margins[y <= 0])
    if not len(toxic) or not len(clean):
        return 0.0
    every = np.unique(margins)
    cuts = np.append((every[1:] + every[:-1]) / 2, 0.0)
    missed = np.searchsorted(toxic, cuts) / len(toxic)
    alarms = 1.0 - np.searchsorted(clean, cuts) / len(clean)
    loss = missed + ALARM_COST * alarms
    good = cuts[loss <= loss.min() + 1e-12]
    return float(good[np.argmin(np.abs(good))])


def train(
    rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = 8, lasso: float = 16.0, seed: int = 3
) -> Machine:
    """A machine fitted on all rows, with its bias set by rows that others of its kind were not fitted on."""
    machine = fitted(rows, y, epochs, lasso, seed)
    margins = np.zeros(len(rows))
    order = np.random.default_rng(seed).permutation(len(rows))
    for fold in range(FOLDS if len(rows) >= FOLDS else 0):
        held = np.zeros(len(rows), bool)
        held[order[fold::FOLDS]] = True
        other = fitted([r for r, h in zip(rows, held) if not h], y[~held], epochs, lasso, seed)
        places = places_of(other)
        for i in np.flatnonzero(held):
            margins[i] = margin(other, places, rows[i][0])
    machine.bias -= parting(margins, y)
    return machine


def fitted(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int, lasso: float, seed: int) -> Machine:
    """Fit by proximal (FTRL) steps for weights and Adagrad for vectors, row by row."""
    rng = np.random.default_rng(seed)
    found = np.zeros(BUCKETS, np.int64)
    for ids, _ in rows:
        found[ids] += 1
    common = found >= LEAST_DOCUMENTS
    rows = [ids[common[ids]] for ids, _ in rows]
    prior = (float(y.sum()) + 0.5) / (len(y) + 10.0)
    bias = float(np.log(prior / (1.0 - prior)))
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    vectors = rng.normal(0.0, 0.02, (BUCKETS, RANK)).astype(np.float32)
    squares = np.full((BUCKETS, RANK), 1e-2, np.float32)
    alpha, beta, ridge = 0.2, 1.0, 0.1

    def weights_at(ids):
        size = np.abs(z[ids]) - lasso
        return np.where(size > 0, -np.sign(z[ids]) * size / ((beta + np.sqrt(n[ids])) / alpha + ridge), 0.0)

    for _ in range(epochs):
        for at in rng.permutation(len(rows)):
            ids = rows[at]
            w = weights_at(ids)
            used = ids[w != 0]
            v = vectors[used]
            total = v.sum(axis=0)
            p = sigmoid(bias + w.sum() + interactions(v))
            g = float(p - y[at])
            bias -= 0.01 * g
            after = n[ids] + g * g
            z[ids] += g - (np.sqrt(after) - np.sqrt(n[ids])) / alpha * w
            n[ids] = after
            if len(used):
                step = g * (total - v) + 1e-3 * v
                squares[used] += step * step
                vectors[used] = v - 0.02 * step / np.sqrt(squares[used])
    weights = weights_at(np.arange(BUCKETS)).astype(np.float32)
    terms = np.flatnonzero(weights).astype(np.int32)
    return Machine(bias, weights, terms, vectors[terms])


def prepare(machine: Machine):
    places = places_of(machine)

    def score(text: bytes) -> float:
        return float(sigmoid(margin(machine, places, term_ids(text))))

    return score


def learned(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = SAMPLE) -> training.Scorer:
    """A scorer fitted on a sample of labelled documents that are not held out."""
    sample = training.labelled_sample(docs, labels, label, bound)
    return training.Scorer(training.fit(sample, features, train, Machine), prepare)


def report(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, bound: int = SAMPLE) -> DataFrame:
    """Every row's score and prediction.

    Null texts score like empty ones: by the bias. Without any label the score is a low prior.
    Rows are neither dropped nor merged, and other columns are not looked at.
    """
    return training.report(docs, learned(docs, labels, bound=bound), threshold)
