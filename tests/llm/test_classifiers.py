import random
import zlib

import numpy as np
import pytest

from mercato.llm import quality, toxicity, training
from mercato.llm.queries import op2_toxicity, op5_quality_classifier

SF = "/root/testdata/sf0.01"


def out(id):
    return id is not None and zlib.crc32(str(id).encode()) % 5 == 0


def pairs_corpus(size=1500, seed=1):
    """Toxic only if an insult and a group mention meet: no sum of weights tells them apart."""
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices([f"filler{k}x" for k in range(60)], k=20)
        words += ["rotten"] * a + ["villagers"] * b
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(a and b)))
    return rows


def test_pairs_are_learned():
    rows = pairs_corpus()
    found = [toxicity.features(t.encode()) for _, t, _ in rows]
    y = np.array([v for *_, v in rows], np.float32)
    machine = toxicity.train(found[:1200], y[:1200], epochs=20, lasso=2.0)
    score = toxicity.prepare(machine)
    guess = np.array([score(t.encode()) >= 0.5 for _, t, _ in rows[1200:]])
    assert (guess == (y[1200:] == 1)).mean() > 0.97
    assert len(machine.terms) and np.abs(machine.vectors).max() > 0.1


def test_interactions_equal_the_sum_over_pairs():
    v = np.random.default_rng(0).normal(size=(6, 3))
    want = sum(v[i] @ v[j] for i in range(6) for j in range(i))
    assert toxicity.interactions(v) == pytest.approx(want)


def test_folded_scores_equal_the_full_network():
    rows = [(quality.features(t.encode()), y) for t, y in [("good plain words", 1), ("bad*** bad*** x", 0)] * 20]
    model = quality.train([f for f, _ in rows], np.array([y for _, y in rows], np.float32))
    score = quality.prepare(model)
    for text in ("good words bad***", "x", "plain é中"):
        ids, counts = quality.features(text.encode())
        hidden = counts @ model.vectors[ids] / counts.sum()
        odds = np.exp(model.softmax @ hidden + model.bias)
        assert score(text.encode()) == pytest.approx(odds[1] / odds.sum(), rel=1e-4)
    assert score(b"good plain words") > 0.5 > score(b"bad*** bad***")


def test_long_texts_have_the_same_features_in_any_chunk(monkeypatch):
    text = ("word é中 again again\n" * 300).encode()
    ids, counts = quality.features(text)
    monkeypatch.setattr(quality, "CHUNK", 37)
    again = quality.features(text)
    assert (ids == again[0]).all() and (counts == again[1]).all()


@pytest.mark.parametrize(
    "query, label, floor", [(op2_toxicity, "toxic", 0.93), (op5_quality_classifier, "quality", 0.97)]
)
def test_held_out_rows_are_ranked_well(spark, query, label, floor):
    rows = query(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(rows) == docs.count()
    assert all(r.held_out == out(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    known = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(r.score, known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    good = [s for s, y in held if y == 1]
    bad = [s for s, y in held if y == 0]
    wins = sum((a > b) + 0.5 * (a == b) for a in good for b in bad)
    assert wins / (len(good) * len(bad)) > floor


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, module):
    texts = ["", None, " \n", "one", "x" * 300000, "word " * 100000, "é中🙂 *** ###"]
    docs = [(i, t, "s", 0.5) for i, t in enumerate(texts)] + [(None, "one", None, None), (3, "one", "t", 1.0)]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, id string, score double")
    marks = [(i, 1, i % 2) for i in range(40)] + [(None, 1, 1), (3, None, None), (3, 0, 1)]
    labels = spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int")
    rows = module.report(df, labels).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (0, 1, 2)}) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    assert len({r.score for r in rows if r.doc_id == 3}) == 1
    assert module.report(df.limit(0), labels).count() == 0
    assert module.report(df, labels.limit(0)).count() == len(docs)


def test_samples_are_bounded_and_leave_held_out_rows_alone(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "cast(id as string) text")
    docs = docs.union(spark.createDataFrame([(1, "0 other"), (2, None)], "doc_id bigint, text string"))
    labels = spark.range(3000).selectExpr("id doc_id", "cast(id % 2 as int) toxic")
    rows = training.labelled_sample(docs, labels, "toxic", 500).collect()
    assert 400 < len(rows) < 600
    assert not any(out(r.id) for r in rows)
    assert len({r.id for r in rows}) == len(rows)
    every = training.labelled_sample(docs, labels, "toxic", 10000).collect()
    assert {r.id for r in every} == {i for i in range(3000) if not out(i)}


def test_pairs_with_a_term_that_is_neutral_alone_are_learned():
    """With the production parameters: the mention says which of two words counts, and nothing alone."""
    rng = random.Random(1)
    rows = []
    for _ in range(1500):
        a, b, mention = (rng.random() < 0.5 for _ in range(3))
        words = rng.choices([f"filler{k}x" for k in range(60)], k=20)
        words += ["rotten"] * a + ["stinking"] * b + ["villagers"] * mention
        rng.shuffle(words)
        rows.append((" ".join(words).encode(), int(a if mention else b)))
    y = np.array([v for _, v in rows], np.float32)
    machine = toxicity.train([toxicity.features(t) for t, _ in rows[:1200]], y[:1200])
    score = toxicity.prepare(machine)
    guess = np.array([score(t) >= 0.5 for t, _ in rows[1200:]])
    assert (guess == (y[1200:] == 1)).mean() > 0.97


def test_toxic_documents_are_found_and_clean_ones_left_alone(spark):
    """Decisions, on rows that were held out."""
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic").dropna()
    rows = op2_toxicity(spark, folder).filter("held_out").join(labels, "doc_id").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    clean = [r.predicted for r in rows if not r.toxic]
    assert sum(toxic) >= 0.9 * len(toxic)
    assert sum(clean) <= 0.01 * len(clean)


def test_parting_margin():
    margins, y = np.array([-5.0, -4.0, -1.0, 2.0, 3.0]), np.array([0, 0, 1, 1, 1])
    assert toxicity.parting(margins, y) == -2.5
    assert toxicity.parting(margins, np.zeros(5)) == 0.0
    assert toxicity.parting(np.zeros(0), np.zeros(0)) == 0.0
