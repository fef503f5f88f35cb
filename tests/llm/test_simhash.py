import re

import numpy as np
import pytest
import xxhash

from mercato.llm import simhash
from mercato.llm.components import components


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_roots(values, max_bits):
    root = {v: v for v in values}
    changed = True
    while changed:
        changed = False
        for a in values:
            for b in values:
                if bin((a ^ b) & (2**64 - 1)).count("1") <= max_bits and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    changed = True
    return root


TEXTS = [
    "The quick brown Fox jumps over the lazy dog",
    "the quick brown fox jumps over the lazy dog",
    "",
    None,
    " \n ",
    "one",
    "two words",
    "ÄRGER é 中文   x y 🙂 z",
    "a b c " * 700,
    "long " + "word " * 70000 + "end",
]


def test_fingerprints_equal_brute_force():
    for text in TEXTS:
        got = simhash.fingerprint_of((text or "").encode()) & (2**64 - 1)
        assert got == brute_print(text)


def test_documents(spark):
    rows = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, "one", "y", 2), (0, TEXTS[0], "z", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fingerprint string, f int")
    got = {(r.id, r.fingerprint & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(docs).collect()}
    prints = [(i, brute_print(t)) for i, t, *_ in rows]
    root = brute_roots(sorted({p for _, p in prints}), 2)
    want = set()
    for i, p in prints:
        ids = [j for j, q in prints if root[q] == root[p] and j is not None]
        want.add((i, p, min(ids) if ids else None))
    assert got == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for *_, c in want})


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.drop_near_duplicates(docs).count() == 0


@pytest.mark.parametrize("max_bits", [2, 4])
def test_links_keep_every_component(spark, max_bits):
    """Random prints, a dense ball around one value, and chains."""
    rng = np.random.default_rng(max_bits)
    center = 0x0123456789ABCDEF
    values = {int(v) for v in rng.integers(-(2**62), 2**62, 150)}
    for _ in range(150):  # near copies: up to 4 of 12 bits changed
        values.add(center ^ int(sum(1 << int(b) for b in set(rng.integers(0, 12, 4)))))
    chain = 77 << 40
    for b in range(0, 60, max_bits):
        values.add(chain)
        chain ^= sum(1 << (b + k) for k in range(max_bits))
    values = sorted(simhash._signed(v & (2**64 - 1)) for v in values)
    df = spark.createDataFrame([(v,) for v in values], "f bigint")
    roots = {r.node: r.root for r in components(simhash.linked(df, max_bits)).collect()}
    want = brute_roots(values, max_bits)
    assert {v: roots.get(v, v) for v in values} == want


def test_allocation_is_optimal_and_complete():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 400, (50, 3)).astype(float)
    sizes, spread = [[1.0, 23.0], [1.0, 22.0], [1.0, 22.0]], [0.5, 1.0, 1.0]
    chosen, cost = simhash.allocate(counts, sizes, spread, 0)
    options = [(a, b, c) for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) if a + b + c == 0]

    def price(row, option):
        return sum(
            0 if e < 0 else sizes[i][e] + row[i] + (sizes[i][e] - 1) * spread[i]
            for i, e in enumerate(option)
        )

    for row, got, paid in zip(counts, chosen, cost):
        assert sum(got) == 0
        assert paid == pytest.approx(min(price(row, o) for o in options))


def test_odd_distance_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.linked(spark.createDataFrame([(1,)], "f bigint"), 3)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 2), (10, 11), (5, 5), (20, 19), (19, 18), (18, 17), (None, 4)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 17: 17, 18: 17, 19: 17, 20: 17}


def test_repeated_rows_are_dropped_before_the_join(spark):
    """Half of the rows are one row; each task hands on one of them."""
    docs = spark.range(4000).repartition(8).selectExpr(
        "if(id % 2 = 0, 0, id) doc_id", "if(id % 2 = 0, 'the same text again', concat('text number ', md5(cast(id as string)))) text",
    )
    found = simhash.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in found.collect() if r.doc_id == 0) == [0]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate [__row_key")
