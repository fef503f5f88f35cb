"""Byte-level BPE ids of texts by a rank file, and back to bytes.

Encoding is tiktoken's, with a rank file and a split pattern given by the
caller. Long texts are cut first where no match of the pattern can reach across:
before a space or line feed that follows an ASCII letter or digit. A match never holds a
blank after another character, and a run of blanks stays whole, so the pieces
give the same ids as the whole text. Decoding gives raw bytes, so an id list that ends
within a character survives.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import made_once, share, whole_text, without

#: A longer text is cut at the first safe place after so many characters.
PIECE = 65536
#: Rows whose ids and bytes go back to Spark at a time; they take far more room than their texts.
ROWS_OUT = 256
SAFE = re.compile(r"(?<=[A-Za-z0-9])[ \n]")
#: Blanks in the sense of the pattern, in runs too long for its search, which recurses on them.
LONG_BLANK = re.compile(
    r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{20000,}"
)


@dataclass(frozen=True)
class Ranks:
    """A rank file's content, and the pattern that splits texts before its merges."""

    content: bytes
    pattern: str


def encoder_of(content: bytes, pattern: str) -> tiktoken.Encoding:
    pairs = (line.split() for line in content.splitlines() if line)
    ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def load_ranks(path: str, pattern: str) -> Ranks:
    """Read a rank file on the driver; it goes to tasks as a broadcast of its bytes (a megabyte)."""
    with open(path, "rb") as file:
        return Ranks(file.read(), pattern)


def pieces(text: str, size: int = PIECE) -> list[str]:
    """The text cut at safe places, each piece at least ``size`` long but the last."""
    found, start = [], 0
    while len(text) - start > size:
        place = SAFE.search(text, start + size)
        if place is None:
            break
        found.append(text[start : place.start()])
        start = place.start()
    found.append(text[start:])
    return found


def encode_text(encoder: tiktoken.Encoding, text: str) -> list[int]:
    """The ids of one text, as if it were encoded at once.

    In a very long run of blanks the pattern matches all but the last, which
    goes with what follows, or all at the end of the text; that match is merged
    directly, as its search would overflow the stack. tiktoken names this merge
    ``_encode_single_piece``, which is no public name: a release without it raises here.
    """
    if len(text) <= PIECE:
        return encoder.encode_ordinary(text)
    ids: list[int] = []
    start = 0
    for run in [*LONG_BLANK.finditer(text), None]:
        before = text[start : run.start() if run else len(text)]
        for piece in pieces(before):
            ids += encoder.encode_ordinary(piece)
        if run:
            start = run.end() if run.end() == len(text) else run.end() - 1
            ids += encoder._encode_single_piece(text[run.start() : start])
    return ids


def _encoded(encoder: tiktoken.Encoding, texts: pa.Array) -> pa.Array:
    ends, ids = [0], []
    for t in texts:
        found = encode_text(encoder, t.as_py() or "")
        ends.append(ends[-1] + len(found))
        ids.append(np.array(found, np.int32))
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _decoded(encoder: tiktoken.Encoding, lists: pa.Array) -> pa.Array:
    found = []
    for one in lists:
        values = one.values
        found.append(encoder.decode_bytes(values.to_numpy().tolist() if values is not None else []))
    return pa.array(found, pa.binary())


def encode(spark: SparkSession, text: Column, ranks: Ranks) -> Column:
    """The ids of a string column as array<int>; a null text has none."""
    shared = share(spark, **vars(ranks))

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        return _encoded(made_once(shared, encoder_of), texts)

    return run(text)


def decode(spark: SparkSession, ids: Column, ranks: Ranks) -> Column:
    """The bytes of an array<int> column; null gives none."""
    shared = share(spark, **vars(ranks))

    @F.arrow_udf("binary")
    def run(lists: pa.Array) -> pa.Array:
        return _decoded(made_once(shared, encoder_of), lists)

    return run(ids)


def with_ids(spark: SparkSession, docs: DataFrame, ranks: Ranks, text: str = "text") -> DataFrame:
    """``docs`` with ``ids``; null and empty texts have none, rows are never dropped."""
    kept = without(docs.withColumn("__ids", encode(spark, whole_text(text), ranks)), "ids")
    return kept.withColumnRenamed("__ids", "ids")


def tokenized(spark: SparkSession, docs: DataFrame, ranks: Ranks, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``ids``, their count, and digests of the ids and of the decoded bytes, by row."""
    shared = share(spark, **vars(ranks))
    rows = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), whole_text(text).alias("text"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = made_once(shared, encoder_of)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(start, ROWS_OUT)
                ids = _encoded(encoder, part.column(1))
                columns = [part.column(0), ids, _decoded(encoder, ids)]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "bytes"])

    back = rows.mapInArrow(both, "doc_id bigint, ids array<int>, bytes binary")
    listed = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return back.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(listed.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("bytes", 256).alias("decoded_sha256"),
        "ids",
    )


def report(spark: SparkSession, docs: DataFrame, ranks: Ranks, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes, by row.

    Ids are integers; text that is none raises. Null texts count as empty. Repeated rows are all
    listed, other columns are left out, so their names cannot clash, and an empty table gives no rows.
    """
    return tokenized(spark, docs, ranks, id, text).drop("ids")
