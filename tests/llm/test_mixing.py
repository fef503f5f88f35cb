import hashlib

import pytest
from pyspark.sql import functions as F

from mercato.llm import mixing
from mercato.operators import ranking

SCHEMA = "doc_id bigint, source string, text string, Size string"


def shares(sizes, weights, repeats=3):
    """Targets by plain resharing, in exact fractions of the total."""
    from fractions import Fraction

    total, capped = sum(sizes.values()), {}
    while True:
        rest = total - sum(capped.values())
        open_ = [s for s in sizes if s not in capped]
        whole = sum(weights[s] for s in open_)
        targets = {s: Fraction(rest * weights[s], whole) for s in open_}
        over = [s for s in open_ if targets[s] > repeats * sizes[s]]
        if not over:
            return capped | targets
        capped |= {s: repeats * sizes[s] for s in over}


def brute_force(rows):
    rows = [(i, s, len([w for w in (t or "").split() if w])) for i, s, t, _ in rows]
    sizes = {}
    for _, s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    targets = {s: float(t) for s, t in shares(sizes, weights).items()}
    queue = []
    for s in names:
        done = 0
        for turn in range(3):
            def place(r):
                text = f"mix:{'' if r[1][0] is None else r[1][0]}:{turn}"
                number = int(hashlib.md5(text.encode()).hexdigest()[:15], 16)
                return number, r[1][0] is None, r[1][0] or 0, r[1][2], r[0]

            for k, (i, _, n) in sorted(((k, r) for k, r in enumerate(rows) if r[1] == s and r[2]), key=place):
                done += n
                queue.append((done / targets[s], names.index(s), len(queue), k, n))
    room, taken = sum(sizes.values()), [0] * len(rows)
    for *_, k, n in sorted(queue):
        taken[k] += min(n, room)
        room -= min(n, room)
    found = [(i, n, sizes[s], targets[s], taken[k]) for k, (i, s, n) in enumerate(rows)]
    return sorted(found, key=str), targets


def mixed(spark, rows, parts=3):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in mixing.mix(docs).collect()), key=str)


def some_rows():
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", " ".join(["w"] * (i * i % 23)), "x") for i in range(120)]
    rows += [(1000, "tiny", "one\ttwo \n three", "x"), (None, None, "a b", None), (None, None, None, None)]
    rows += [(7, "copies", "a b c", "x")] * 5 + [(8, "silent", "", "x"), (9, "silent", " \t\x0b ", "x")]
    return rows


@pytest.mark.parametrize("bucket", [7, 200_000])
def test_equals_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", bucket)
    rows = some_rows()
    expected, targets = brute_force(rows)
    found = mixed(spark, rows)
    assert found == expected
    assert sum(r[4] for r in found) == sum(r[1] for r in found)
    assert all(r[4] <= 3 * r[1] for r in found)


def test_reruns_agree_however_the_rows_lie(spark):
    assert mixed(spark, some_rows(), 1) == mixed(spark, some_rows()[::-1], 5)


def test_words_of_a_source_come_near_its_target(spark):
    rows = [(i, "abcde"[min(i % 9, 4)], "w " * (1 + i % 40), None) for i in range(2000)]
    by_target = {}
    for _, size, _, target, taken in mixed(spark, rows):
        by_target.setdefault(target, []).append(taken)
    _, targets = brute_force(rows)
    for target, taken in by_target.items():
        sources = sum(1 for t in targets.values() if t == target)
        assert abs(sum(taken) - sources * target) <= 40 * sources


@pytest.mark.parametrize("sizes", [[1], [0, 0], [10, 1000, 1000], [1, 1, 1, 10**6], [5, 10, 2, 900, 3, 80]])
def test_targets_share_out_all_words(spark, sizes):
    rows = [(f"s{i:02}", n, (5, 2, 1)[i % 3]) for i, n in enumerate(sizes)]
    found = mixing.targets(spark.createDataFrame(rows, "name string, size bigint, weight bigint"))
    got = {r["name"]: r["target"] for r in found.collect()}
    expected = shares({n: s for n, s, _ in rows}, {n: w for n, _, w in rows})
    assert got == {n: float(t) for n, t in expected.items()}


def test_empty_table(spark):
    assert mixed(spark, []) == []


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame(some_rows(), SCHEMA)
    words = docs.select(mixing.count_words(F.col("text")).alias("n"))
    plans = words._jdf.queryExecution().toString() + mixing.mix(docs)._jdf.queryExecution().toString()
    assert "Python" not in plans and "Arrow" not in plans
