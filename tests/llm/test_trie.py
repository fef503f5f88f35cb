import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from mercato.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, Path string"


def sequences(rows):
    own = {}
    for c, t, role, text, *_ in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))

    def step(entry):
        role, text = entry[2:]
        return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]

    return {c: [e[2:] for e in sorted(turns, key=lambda e: (*e[:2], step(e)))] for c, turns in own.items()}


def rebuilt(own):
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        found[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    return found


def brute_force(paths):
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    children = {}
    for node in nodes:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(nodes, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        own = (len(nodes[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
        saved[node] = own + sum(saved[b] for b in below)
    rows = []
    for node, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if paths[c] == node)
        parent = min(nodes[node[:-1]]) if node else None
        rows.append(
            (min(members), len(node), parent, len(members), len(children.get(node, [])), leaves[node], saved[node])
            + (hashlib.sha256(ends.encode()).hexdigest(),)
        )
    return sorted(rows, key=str)


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def some_rows(seed, convs=80, copies=20, deep=60):
    pick = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(pick.randint(1, 8)):
            rows.append((c, t, pick.choice(["user", "assistant"]), pick.choice(["a", "é", "", "long text"]), "x"))
    for c in range(1000, 1000 + copies):
        rows += [(c, t, "user", f"copy {t}", "x") for t in range(10)]
    for c in (2000, 2001, 2003):
        rows += [(c, t, "user", f"deep {t if t < deep - c % 5 else c}", "x") for t in range(deep)]
    rows += [(-7, None, None, None, None), (-7, None, "user", None, None), (-7, 0, None, "x", None)]
    rows += [(None, 1, "user", "nobody", None), (3000, 1, "user", "twice", "x"), (3000, 1, "user", "twice", "x")]
    return rows


@pytest.mark.parametrize("parts", ["1", "4", "40", "400"])
def test_equals_brute_force_over_any_ranges(spark, parts):
    rows = some_rows(int(parts))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = collected(trie.report(spark.createDataFrame(rows, SCHEMA)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found == brute_force(rebuilt(sequences(rows)))


def test_turnless_conversations_end_on_the_root(spark):
    rows = [(c, 0, "user", "hi", None) for c in (1, 2, 3, 4, 6)]
    found = collected(trie.report(spark.createDataFrame(rows, SCHEMA)))
    expected = brute_force(rebuilt(sequences(rows)))
    assert found == expected and any(r[1] == 0 and r[3] == 5 for r in found)


def test_own_paths_without_rebuilding(spark):
    rows = some_rows(5)
    docs = spark.createDataFrame(rows, SCHEMA)
    own = {c: tuple(p) for c, p in sequences(rows).items()}
    assert collected(trie.prefix_trie(trie.conversation_paths(docs))) == brute_force(own)


def test_role_and_text_are_told_apart(spark):
    rows = [(1, 0, "ab", "c", None), (2, 0, "a", "bc", None), (3, 0, "", "abc", None)]
    paths = trie.conversation_paths(spark.createDataFrame(rows, SCHEMA))
    assert paths.agg(F.count_distinct("path")).first()[0] == 3


def test_empty_table(spark):
    assert trie.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_tasks_give_pieces_that_a_second_pass_joins():
    """Every way to cut sorted conversations into ranges gives the same nodes."""
    paths = sorted([(p.encode(), c) for c, p in enumerate(["", "a", "ab", "ab", "abc", "abd", "b", "b", "ba"])])
    paths = [(b"".join(bytes([x]) * trie.DIGEST + b"\0\0\0\1" for x in p), c) for p, c in paths]

    def nodes(cuts):
        whole = trie._Peeler(True)
        for place, (start, end) in enumerate(zip([0, *cuts], [*cuts, len(paths)])):
            peeler = trie._Peeler(False)
            for path, c in paths[start:end]:
                part = {"least": c, "count": 1, "children": 0, "leaves": 0, "saved": 0, "ends": str(c).encode()}
                peeler.add(path, len(path) // trie.STEP, [part])
            peeler.end(place)
            for row in peeler.out:
                if "key" in row:
                    whole.out.append(row)
                else:
                    whole.add(row["path"], row["first"], row["parts"])
        whole.end(0)
        return sorted(whole.out, key=str)

    one = nodes([])
    assert len(one) == 7
    for a in range(1, len(paths)):
        for b in range(a, len(paths) + 1):
            assert nodes([a, b]) == one
