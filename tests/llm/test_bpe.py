import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from mercato.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def plain():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_long_texts_encode_as_a_whole(plain):
    rng = random.Random(5)
    alphabet = ["a", "B", "7", " ", "  ", "\n", "\n\n", "'s", "é", "中", "🙂", "#", "\t", " ", "word", "<|endoftext|>"]
    for _ in range(20):
        text = "".join(rng.choices(alphabet, k=60000))
        assert len(bpe.pieces(text, 1000)) > 10
        assert "".join(bpe.pieces(text, 1000)) == text
        got = [i for p in bpe.pieces(text, 1000) for i in plain.encode_ordinary(p)]
        assert got == plain.encode_ordinary(text)
        assert bpe.encode_text(plain, text) == got


@pytest.mark.parametrize("blank", [" ", "\n", " \n", " \t"])
@pytest.mark.parametrize("end", ["", "x", "é y", "#"])
def test_long_blank_runs(plain, blank, end):
    text = "start" + blank * 40000 + end
    assert bpe.encode_text(plain, text) == plain.encode_ordinary(text)


def test_texts_that_overflow_the_pattern(plain):
    for text in (" " * 3_000_000 + "a", "a" * 1_000_000, " \n" * 1_000_000):
        ids = bpe.encode_text(plain, text)
        assert plain.decode_bytes(ids) == text.encode()


def test_report(spark, plain):
    texts = ["Hello world's 123", "", None, "é🙂中", "<|endoftext|>", "tail \n\n  end ", "word " * 50000, "x"]
    rows = [(i, t, [1], "a") for i, t in enumerate(texts)] + [(None, "x", None, None), (0, texts[0], [2], "b")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>, bytes string")
    ranks = bpe.load_ranks(PATH, public_tokenizers.PATTERN)
    want = []
    for i, t, *_ in rows:
        ids = plain.encode_ordinary(t or "")
        joined = " ".join(map(str, ids)).encode()
        want.append((i, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = sorted(map(tuple, bpe.report(spark, docs, ranks).collect()), key=str)
    assert got == sorted(want, key=str)
    wide = bpe.with_ids(spark, docs, ranks)
    assert sorted(wide.columns) == ["bytes", "doc_id", "ids", "text"]
    assert bpe.report(spark, docs.limit(0), ranks).count() == 0


def test_decoding_keeps_broken_characters(spark, plain):
    ranks = bpe.load_ranks(PATH, public_tokenizers.PATTERN)
    ids = plain.encode_ordinary("🙂")[:1]
    df = spark.createDataFrame([(ids,), ([],), (None,)], "ids array<int>")
    from pyspark.sql import functions as F

    got = [bytes(r[0]) for r in df.select(bpe.decode(spark, F.col("ids"), ranks)).collect()]
    assert got == [plain.decode_bytes(ids), b"", b""]
