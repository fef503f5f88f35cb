import hashlib
import uuid
import zlib

import pytest
from pyspark.sql import functions as F

from mercato.llm import merkle
from mercato.session import shared_folder

SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, Leaf string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(row):
    return digest(*[framed(v) for v in row[:5]])


def climb(nodes):
    """The root over ``nodes`` and, for each, the siblings level by level."""
    paths = [[] for _ in nodes]
    places = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
            paths[i].append((run[: at % 3], run[at % 3 + 1 :]))
            places[i] = at // 3
        nodes = [digest(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute_force(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append(row)
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = []
    for name in names:
        mine = sorted(by_source[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees.append((mine, *climb([leaf(r) for r in mine])))
    root, upper = climb([t[1] for t in trees])
    found = []
    for (mine, subroot, paths), above in zip(trees, upper):
        for row, path in zip(mine, paths):
            now = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                now = (*row[:4], row[4].replace("\n", ""), *row[5:])
            folded = leaf(now)
            for before, after in path + above:
                folded = digest(*before, folded, *after)
            siblings = digest(*[s for pair in path + above for part in pair for s in part])
            found.append((row[0], leaf(row), subroot, root, siblings, folded, folded == root))
    return sorted(found, key=str)


def reported(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    folder = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    return sorted((tuple(r) for r in merkle.report(spark, docs, folder).collect()), key=str)


def some_rows(n):
    rows = [
        (i * 7 % n, None if i % 11 == 0 else "a" if i % 3 else f"s{i % 5}", "en", i, f"line {i}\nnext é\n" if i % 4 else f"flat {i}", "x")
        for i in range(n)
    ]
    rows += [(None, "a", None, None, None, None), (None, "a", None, None, "\n", None), (5, "lone", "en", 1, "", "x")]
    rows += [(3, "copies", "en", 4, "same\ntext", "x")] * 10
    return rows


@pytest.mark.parametrize("stride", [1, 2, 6])
def test_equals_brute_force(spark, monkeypatch, stride):
    monkeypatch.setattr(merkle, "STRIDE", stride)
    monkeypatch.setattr(merkle, "BLOCK", 3**stride)
    rows = some_rows(100)
    found = reported(spark, rows)
    assert found == brute_force(rows)
    assert {r[-1] for r in found} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_one_source_of_any_size(spark, n):
    rows = [(i, "only", "en", 1, f"t\n{i}", None) for i in range(n)]
    assert reported(spark, rows) == brute_force(rows)


def test_empty_table(spark):
    assert reported(spark, []) == []


def test_one_changed_byte_changes_the_root_and_fails_its_proof_alone(spark):
    rows = spark.createDataFrame([(i, "s", f"text {i}") for i in range(40)], "id int, s string, t string")
    leaves = rows.select("id", "s", merkle.leaf_digest([F.col("id"), F.col("t")]).alias("leaf"))
    folder = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    made = merkle.write_manifest(spark, leaves, folder, source="s", order="id")
    asked = made.leaves.filter("given.id in (0, 17, 39)").select("tree", "rank", "leaf")
    proven = made.prove(asked)
    folded = merkle.folded(F.col("leaf"), F.col("path"))
    assert [r[0] for r in proven.select(folded == F.col("root")).collect()] == [True] * 3
    wrong = merkle.folded(F.when(F.col("rank") == 17, F.sha2(F.lit("x"), 256)).otherwise(F.col("leaf")), F.col("path"))
    assert sorted(r[0] for r in proven.select(wrong == F.col("root")).collect()) == [False, True, True]
    other = rows.withColumn("t", F.when(F.col("id") == 17, "text").otherwise(F.col("t")))
    leaves = other.select("id", "s", merkle.leaf_digest([F.col("id"), F.col("t")]).alias("leaf"))
    again = merkle.write_manifest(spark, leaves, folder + "-other", source="s", order="id")
    assert made.root != again.root


def test_equal_nodes_are_stored_once(spark):
    rows = spark.createDataFrame([(1, f"s{i % 2}", "same") for i in range(54)], "id int, s string, leaf string")
    folder = f"{shared_folder(spark)}/manifest-{uuid.uuid4().hex}"
    merkle.write_manifest(spark, rows, folder, source="s", order="id")
    assert spark.read.parquet(f"{folder}/records/0").count() == 1
