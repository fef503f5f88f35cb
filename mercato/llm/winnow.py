"""Benchmark decontamination by winnowing.

Word k-grams are hashed, and of each window of consecutive hashes the smallest is
kept as a fingerprint. A span shared by a document and a benchmark item that is
at least ``window + k - 1`` words long holds a whole window, which gives both the same
fingerprint, so every such span is found. Fingerprints are joined, and each hit
is extended word by word to the whole shared run; runs as long as the span count.
Items shorter than the span are one window of their own length and are
found by hashes of just that length.

The benchmark is the stated query set. It is taken in blocks of bounded size,
each collected by the driver and broadcast to tasks that pass over the documents. What a block
finds is stored with the documents before the next block is broadcast. Documents are neither
shuffled nor collected, so hot passages and sources have no effect.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import made_once, share, utf8, without
from mercato.session import checkpoint

SPAN = 13
GRAM = 8
#: Bytes of benchmark text in one broadcast, about.
BLOCK_BYTES = 32 << 20

#: Upper case to lower; every byte that is not of a word to a space. Bytes of
#: characters beyond ASCII are word bytes.
FOLD = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_COEFFICIENTS = np.random.default_rng(7).integers(1, 1 << 63, SPAN * 4, dtype=np.uint64) | np.uint64(1)
NO_WORDS = np.zeros(0, np.uint64)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def hashes_of(words: list[bytes]) -> np.ndarray:
    """A hash for each word; equal only within one Python process."""
    return np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of every run of ``size`` words."""
    count = len(hashes) - size + 1
    if count <= 0:
        return NO_WORDS
    total = hashes[:count] * _COEFFICIENTS[0]
    for k in range(1, size):
        total += hashes[k : k + count] * _COEFFICIENTS[k % len(_COEFFICIENTS)]
    # Mixed, so that the smallest is a random choice.
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(32))


def picked(values: np.ndarray, window: int) -> np.ndarray:
    """Places of the smallest value of each window, without repeats, in order."""
    if len(values) < window:
        return np.zeros(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(values, window)
    flags = np.zeros(len(values), bool)
    flags[views.argmin(axis=1) + np.arange(len(views))] = True
    return np.flatnonzero(flags)


class Block:
    """Benchmark items of one broadcast, with their index."""

    def __init__(self, items: list[tuple[str, bytes]], span: int, gram: int):
        self.items, self.span, self.gram, self._index = items, span, gram, None

    def index(self):
        """``(texts, sizes)``: distinct items as (words, ids), and for each gram size
        the sorted hashes with the places they stand for."""
        if self._index is None:
            ids: dict[tuple, list[str]] = {}
            for item, text in self.items:
                ids.setdefault(tuple(words_of(text)), []).append(item)
            ids.pop((), None)
            texts = [(list(words), sorted(set(names))) for words, names in ids.items()]
            places: dict[int, dict[int, list]] = {}
            for number, (words, _) in enumerate(texts):
                short = len(words) < self.span
                size = len(words) if short else self.gram
                values = grams(hashes_of(words), size)
                at = range(1) if short else picked(values, self.span - self.gram + 1)
                key = -size if short else size
                for place in at:
                    places.setdefault(key, {}).setdefault(int(values[place]), []).append((number, int(place)))
            sizes = {
                key: (np.array(sorted(found), np.uint64), found) for key, found in places.items()
            }
            self._index = texts, sizes
        return self._index

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs ``[start, end)`` of hit words, and the ids of items with occurring windows."""
        texts, sizes = self.index()
        runs: set[tuple[int, int]] = set()
        hit: set[int] = set()
        hashes = hashes_of(words)
        for key, (known, places) in sizes.items():
            values = grams(hashes, abs(key))
            if not len(values):
                continue
            at = np.arange(len(values)) if key < 0 else picked(values, self.span - self.gram + 1)
            near = np.searchsorted(known, values[at])
            near[near == len(known)] = 0
            done: dict[tuple[int, int], int] = {}
            for start in at[known[near] == values[at]].tolist():
                for number, place in places[int(values[start])]:
                    line = (number, start - place)
                    if done.get(line, -1) >= start:
                        continue
                    first, end = self._extend(words, texts[number][0], start, place)
                    done[line] = end
                    if end - first >= min(self.span, len(texts[number][0])):
                        runs.add((first, end))
                        hit.add(number)
        return sorted(runs), {name for n in hit for name in texts[n][1]}

    @staticmethod
    def _extend(words: list[bytes], item: list[bytes], at: int, place: int) -> tuple[int, int]:
        """The run of equal words around a hit; empty if the hash misled."""
        first, end, left, right = at, at, place, place
        while end < len(words) and right < len(item) and words[end] == item[right]:
            end, right = end + 1, right + 1
        if end == at:
            return at, at
        while first > 0 and left > 0 and words[first - 1] == item[left - 1]:
            first, left = first - 1, left - 1
        return first, end


def merged(runs: list[tuple[int, int]]) -> list[int]:
    """Disjoint runs as a flat list of starts and ends."""
    flat: list[int] = []
    for start, end in sorted(runs):
        if flat and start <= flat[-1]:
            flat[-1] = max(flat[-1], end)
        else:
            flat += [start, end]
    return flat


def blocks(benchmark: DataFrame, id: str, text: str, span: int, gram: int, size: int = BLOCK_BYTES):
    """The benchmark as arguments of blocks of about ``size`` bytes, one at a time on the driver.

    Equal rows count once. A null id is listed as an empty name.
    """
    rows = benchmark.select(
        F.coalesce(F.col(f"`{id}`").cast("string"), F.lit("")).alias("id"), utf8(text).alias("text")
    )
    rows = checkpoint(rows.distinct())
    total = rows.agg(F.sum(F.length("text") + 32)).first()[0] or 0
    count = max(1, -(-total // size))
    for k in range(count):
        part = rows.filter(F.pmod(F.xxhash64("id", "text"), F.lit(count)) == k) if count > 1 else rows
        items = [(r.id, bytes(r.text)) for r in part.collect()]
        yield {"items": items, "span": span, "gram": gram}


def _matcher(shared, text: Column, state: Column) -> Column:
    ddl = "struct<n_words: bigint, runs: array<int>, items: array<string>>"

    @F.arrow_udf(ddl)
    def run(texts: pa.Array, states: pa.Array) -> pa.Array:
        block = made_once(shared, Block)
        counts, runs, items = [], [], []
        for t, s in zip(texts, states):
            words = words_of(t.as_py() or b"")
            found, names = block.search(words)
            before = s.as_py()
            old = before["runs"]
            counts.append(len(words))
            runs.append(merged(found + list(zip(old[::2], old[1::2]))))
            items.append(sorted(names.union(before["items"])))
        return pa.StructArray.from_arrays(
            [
                pa.array(counts, pa.int64()),
                pa.array(runs, pa.list_(pa.int32())),
                pa.array(items, pa.list_(pa.string())),
            ],
            names=["n_words", "runs", "items"],
        )

    return run(text, state)


def matched(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    span: int = SPAN,
    gram: int = GRAM,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit``, ``items`` and ``contaminated``.

    A word is hit if it lies in an occurrence of ``span`` consecutive words of an
    item, or of a whole item that has fewer. ``items`` are the ids of items with such
    occurrences, as strings in order. A document is contaminated if a twentieth of its
    words is hit. Null and empty texts have no words; items without words never
    occur; with an empty benchmark nothing is hit. Input columns named like a
    result are replaced, unless one is the text.
    """
    if not 0 < gram <= span <= len(_COEFFICIENTS):
        raise ValueError("gram may not exceed span")
    names = ("n_words", "n_hit", "items", "contaminated")
    state = F.struct(
        F.lit(0).cast("bigint").alias("n_words"),
        F.array().cast("array<int>").alias("runs"),
        F.array().cast("array<string>").alias("items"),
    )
    df, shared = docs.withColumn("__found", state), None
    for block in blocks(benchmark, item_id, item_text, span, gram, block_bytes):
        if shared is not None:
            # The runs are stored before the next block comes, so workers hold one block at a time.
            df = checkpoint(df)
            shared.destroy()
        shared = share(docs.sparkSession, **block)
        df = df.withColumn("__found", _matcher(shared, utf8(text), F.col("__found")))
    runs = F.col("__found.runs")
    hit = F.aggregate(
        F.transform(runs, lambda at, i: F.when(i % 2 == 0, -at).otherwise(at)),
        F.lit(0).cast("bigint"),
        lambda total, v: total + v,
    )
    kept = [f"`{c}`" for c in docs.columns if c.lower() not in names or c.lower() == text.lower()]
    return df.select(
        *kept,
        F.col("__found.n_words").alias("n_words"),
        hit.alias("n_hit"),
        F.col("__found.items").alias("items"),
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Word and hit counts, the digest of item ids, and the verdict, by row."""
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return matched(rows, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with its columns."""
    names = docs.columns
    packed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), F.col(f"`{text}`").alias("__text")
    )
    good = without(matched(packed, benchmark, "__text").filter(~F.col("contaminated")), "__text")
    return good.select(*[F.col(f"__row.`{c}`").alias(c) for c in names])
