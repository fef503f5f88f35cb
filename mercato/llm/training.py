"""Fit a small model on a bounded sample of labelled documents, and score all."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import held_out, made_once, share, utf8

#: A document's features: bucket numbers, each once, and how often each occurs.
Features = Callable[[bytes], tuple[np.ndarray, np.ndarray]]


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, bound: int, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """About ``bound`` rows ``(id, text, y)`` that training may use, or all if there are fewer.

    Held-out ids, null ids and null labels are left out; an id with several labels has the largest; of
    rows with the same id the smallest text is used. Ids are chosen by their
    hash, so a sample does not depend on how the tables lie.
    """
    known = (
        labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{label}`").alias("y"))
        .dropna()
        .filter(~held_out("id"))
        .groupBy("id")
        .agg(F.max("y").cast("int").alias("y"))
    )
    total = known.count()
    if total > bound:
        share = int(bound / total * (1 << 30))
        known = known.filter(F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1 << 30)) < share)
    rows = docs.select(F.col(f"`{id}`").alias("id"), utf8(text).alias("text"))
    # About ``bound`` ids of 16 bytes: the sample's size bounds the broadcast.
    return rows.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def fit(sample: DataFrame, features: Features, train: Callable, kind: type) -> object:
    """The model that ``train(list of (ids, counts), labels)`` gives, fitted in one task.

    ``kind`` is the model's dataclass.

    Features are made where the texts lie; the task sees the sample's features only,
    in the order of ids.
    """

    @F.arrow_udf("struct<ids: binary, counts: binary>")
    def featured(texts: pa.Array) -> pa.Array:
        found = [features(t.as_py() or b"") for t in texts]
        ids = pa.array([i.astype(np.int32).tobytes() for i, _ in found], pa.binary())
        counts = pa.array([c.astype(np.int32).tobytes() for _, c in found], pa.binary())
        return pa.StructArray.from_arrays([ids, counts], names=["ids", "counts"])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = []
        for batch in batches:
            for id, f, y in zip(*batch.columns):
                one = f.as_py()
                rows.append((id.as_py(), np.frombuffer(one["ids"], np.int32), np.frombuffer(one["counts"], np.int32), y.as_py()))
        rows.sort(key=lambda r: r[0])
        model = train([r[1:3] for r in rows], np.array([r[3] for r in rows], np.float32))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))], pa.binary())], names=["model"])

    made = sample.select("id", featured("text").alias("f"), "y").repartition(1)
    stored = made.mapInArrow(once, "model binary").collect()
    return kind(**pickle.loads(stored[0].model)) if stored else train([], np.zeros(0, np.float32))


@dataclass
class Scorer:
    """A model, as a dataclass of arrays, and what turns it into a function of a text."""

    model: object
    prepare: Callable


def scored(docs: DataFrame, scorer: Scorer, text: Column) -> Column:
    """The score of each text as a double."""
    shared = share(docs.sparkSession, **vars(scorer.model))
    kind, prepare = type(scorer.model), scorer.prepare

    @F.arrow_udf("double")
    def run(texts: pa.Array) -> pa.Array:
        one = made_once(shared, lambda **fields: prepare(kind(**fields)))
        return pa.array([one(t.as_py() or b"") for t in texts], pa.float64())

    return run(text)


def report(docs: DataFrame, scorer: Scorer, threshold: float, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row."""
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = rows.select("doc_id", held_out().alias("held_out"), scored(rows, scorer, utf8()).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))
