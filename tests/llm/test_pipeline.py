import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_bpe import PATH
from test_rules import brute as measured
from test_secrets import brute as found_secrets
from test_simhash import brute_print, brute_roots
from test_winnow import brute as hits

import corpus_pipeline
from mercato.llm import bpe, rules

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def staged(spark, docs, folder, out):
    tables = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
        tables.append(docs)
    return tables


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs, staged(spark, docs, SF, str(tmp_path_factory.mktemp("stages")))


def test_each_stage_equals_brute_force_on_its_input(spark, tables):
    docs, stages = tables
    before = {r.doc_id: r for r in docs.collect()}

    kept = {r.doc_id: r for r in stages[0].collect()}
    assert all(r == before[i] for i, r in kept.items())
    good = {r.doc_id for r in rules.report(docs).collect() if r.kept}
    assert set(kept) == good
    assert not any(measured(r.text)[-1] for r in kept.values())

    prints = {i: brute_print(r.text) for i, r in kept.items()}
    roots = brute_roots(sorted(set(prints.values())), 2)
    smallest = {}
    for i, p in sorted(prints.items(), reverse=True):
        smallest[roots[p]] = i
    single = {r.doc_id: r for r in stages[1].collect()}
    assert single == {i: kept[i] for i in smallest.values()}

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {r.doc_id: r for r in stages[2].collect()}
    assert clean == {i: r for i, r in single.items() if not hits(r.text, items)[-1]}

    safe = {r.doc_id: r for r in stages[3].collect()}
    assert set(safe) == set(clean)
    for i, r in safe.items():
        assert found_secrets(r.text)[-1] == ""
        assert r.n_chars == len(r.text)
        if found_secrets(clean[i].text)[-1] == "":
            assert r == clean[i]

    encoder = bpe.encoder_of(open(PATH, "rb").read(), public_tokenizers.PATTERN)
    assert isinstance(encoder, tiktoken.Encoding)
    for r in stages[4].collect():
        ids = encoder.encode_ordinary(safe[r.doc_id].text)
        assert (list(r.ids), r.n_tokens) == (ids, len(ids))
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(safe[r.doc_id].text.encode()).hexdigest()
    assert stages[4].count() == len(safe)


def test_columns_and_decisions(tables):
    docs, stages = tables
    counts = [t.count() for t in (docs, *stages)]
    for table in stages[:-1]:
        assert table.columns == COLUMNS
        assert [f.dataType for f in table.schema] == [f.dataType for f in docs.schema]
    assert counts[0] > counts[1] > counts[2] >= counts[3] == counts[4] == counts[5]


def test_run_equals_the_stages(spark, tables):
    _, stages = tables
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, stages[-1].collect()))


def test_odd_and_empty_documents(spark, tmp_path):
    text = "one ordinary sentence of more than ten different words that every rule will keep"
    rows = [(1, text, "en", None, None), (1, text, "en", None, None), (None, text, None, "s", 3), (None, None, None, None, None), (4, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs = docs.withColumn("fingerprint", F.lit("x")).withColumn("spans", F.lit(1))
    stages = staged(spark, docs, SF, str(tmp_path / "odd"))
    assert [r.doc_id for r in stages[-1].collect()] == [1]
    assert stages[3].columns == docs.columns
    empty = staged(spark, docs.limit(0), SF, str(tmp_path / "empty"))
    assert [t.count() for t in empty] == [0] * 5
