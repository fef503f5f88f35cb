import hashlib
import random
import re

import duckdb
import pytest

from mercato.llm import oracle, winnow


def words(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def brute(text, items, span=13):
    w = words(text)
    hit, names = set(), set()
    for name, item in items:
        v = words(item)
        if not v:
            continue
        size = min(span, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                names.add(str(name))
    listed = ",".join(sorted(names))
    return (
        len(w),
        len(hit),
        len(names),
        hashlib.sha256(listed.encode()).hexdigest(),
        bool(hit) and 20 * len(hit) >= len(w),
    )


def make(seed):
    rng = random.Random(seed)
    kinds = [f"w{i}" for i in range(12)] + ["É", "中文", "Ab"]

    def text(n):
        return " ".join(rng.choices(kinds, k=n))

    items = [(i, text(rng.choice([1, 3, 5, 12, 13, 14, 30]))) for i in range(25)]
    items += [(30, "a " * 40), (31, ""), (32, None), (33, items[0][1]), (34, "Z!z-z, 9_9")]
    docs = [text(rng.choice([0, 5, 40])) for _ in range(10)]
    for _ in range(40):
        parts = [text(rng.choice([0, 3, 200]))]
        for _ in range(rng.choice([1, 2])):
            w = words(rng.choice(items)[1])
            start = rng.randrange(max(1, len(w)))
            parts += [", ".join(w[start : start + rng.choice([11, 12, 13, 14, 40])]).upper(), text(rng.choice([0, 2, 100]))]
        docs.append("\n".join(parts))
    docs += ["a " * 100, "", None, "x " * 3000 + "z z z 9 9", "b" * 100000]
    return docs, items


@pytest.mark.parametrize("seed", [1, 2])
def test_report_equals_brute_force_and_sql(spark, seed):
    texts, items = make(seed)
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, texts[12], None), (0, texts[0], "t")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, items string")
    bench = spark.createDataFrame(items + items[:3], "item_id bigint, text string")
    got = sorted(map(tuple, winnow.report(docs, bench).collect()), key=str)
    assert got == sorted(((i, *brute(t, items)) for i, t, _ in rows), key=str)
    con = duckdb.connect()
    documents, benchmark = docs.toPandas(), bench.toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text FROM documents")
    assert sorted(con.execute(oracle.decontamination()).fetchall(), key=str) == got
    good = winnow.clean(docs, bench)
    assert good.columns == docs.columns
    assert good.count() == sum(not g[-1] for g in got)


def test_blocks_change_nothing(spark):
    texts, items = make(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    one = winnow.matched(docs, bench)
    many = winnow.matched(docs, bench, block_bytes=500)
    assert len(list(winnow.blocks(bench, "item_id", "text", 13, 8, 500))) > 3
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_empty_tables_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(None, "two three")], "item_id bigint, text string")
    assert winnow.report(docs.limit(0), bench).count() == 0
    row = winnow.report(docs, bench.limit(0)).first()
    assert (row.n_words, row.n_hit, row.n_items, row.contaminated) == (3, 0, 0, False)
    row = winnow.report(docs, bench).first()
    assert (row.n_hit, row.n_items, row.contaminated) == (2, 1, True)


def test_one_block_is_broadcast_at_a_time(spark, monkeypatch):
    alive, most = set(), []
    share = winnow.share

    def counted(session, **data):
        shared = share(session, **data)
        alive.add(shared)
        most.append(len(alive))
        destroy = shared.destroy
        shared.destroy = lambda: (alive.discard(shared), destroy())
        return shared

    monkeypatch.setattr(winnow, "share", counted)
    texts, items = make(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert winnow.matched(docs, bench, block_bytes=500).count() == len(texts)
    assert len(most) > 3 and max(most) == 1
