import re

import duckdb

from mercato.llm import oracle, rules

TEXTS = [
    "the cat sat on the mat and the cat sat on the mat again today",
    "",
    None,
    "\n \n",
    "short",
    "One*** two&&& three### four%%% five$$$ six*** seven*** eight*** nine*** ten*** eleven***",
    "same line\nsame line\n\nsame line \nother line\nsame line\nmore and more words in here now",
    "\n".join(["one line of words"] * 3 + ["and another one here"]),
    "LOUD WORDS EVERYWHERE IN THIS TEXT THAT NEVER STOPS SHOUTING AT ITS READERS",
    "é ä ß 中文 🙂 a b x\x0by\x0cz word word2 word3 word4 word5 word6",
    "a b c d e f " * 30,
    " ".join(f"w{i}" for i in range(9000)) + " " + " ".join(f"w{i}" for i in range(40)),
    "this is a perfectly ordinary sentence with enough different words to be kept by everyone",
]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    inside = {i + k for starts in places.values() if len(starts) > 1 for i in starts for k in range(5)}
    n = len(words)
    return (
        n,
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        dup,
        len(inside),
        n < 10 or 100 * len(inside) > 20 * n,
    )


CLEAN = [
    "НАТО и ООН: " + "обычный текст о встрече министров, в котором латиницей пишут только NATO и больше ничего",
    "Η συνάντηση έγινε χθες στην Αθήνα και οι υπουργοί μίλησαν για το ΝΑΤΟ, NATO, και τα επόμενα βήματα",
    " ".join(["这是一段没有空格的普通中文文字，讲的是昨天在北京举行的会议，部长们讨论了下一步的计划以及明年的预算安排和其他问题。" + str(i) for i in range(12)]),
    " ".join(["การประชุมเมื่อวานนี้รัฐมนตรีได้หารือเกี่ยวกับแผนการดำเนินงานขั้นต่อไปและงบประมาณของปีหน้า" + str(i) for i in range(12)]),
]
LONG = " ".join("x" * 50 + str(i) for i in range(12))


def test_clean_text_of_any_script_is_kept(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*CLEAN, LONG, TEXTS[8]])], "doc_id bigint, text string")
    rows = {r.doc_id: r for r in rules.report(docs).collect()}
    assert [rows[i].kept for i in range(6)] == [True] * 4 + [False] * 2
    con = duckdb.connect()
    documents = docs.toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text FROM documents")
    sql = con.execute(f"SELECT doc_id, kept, failed FROM ({oracle.quality_rules()})").fetchall()
    assert sorted(sql) == [(i, rows[i].kept, rows[i].failed) for i in range(6)]


def table():
    return [(i, t, "s", -1) for i, t in enumerate(TEXTS)] + [(None, "x", None, None), (0, TEXTS[0], "t", 1)]


def test_report_equals_brute_force_and_sql(spark):
    docs = spark.createDataFrame(table(), "doc_id bigint, text string, kept string, n_words int")
    rows = rules.report(docs).collect()
    got = sorted((tuple(r[:7]) for r in rows), key=str)
    assert got == sorted(((i, *brute(t)) for i, t, *_ in table()), key=str)
    assert {r.doc_id for r in rows if r.kept} == {6, 9, 11, 12}
    assert all(not r.kept for r in rows if r.base_failed)
    con = duckdb.connect()
    documents = docs.select("doc_id", "text").toPandas()  # noqa: F841
    con.execute("CREATE TABLE documents AS SELECT doc_id::BIGINT AS doc_id, text FROM documents")
    names = [c for c in rules.report(docs).columns]
    cursor = con.execute(oracle.quality_rules())
    assert sorted(d[0] for d in cursor.description) == sorted(names)
    order = [[d[0] for d in cursor.description].index(n) for n in names]
    sql = sorted((tuple(r[i] for i in order) for r in cursor.fetchall()), key=str)
    assert sql == sorted(map(tuple, rows), key=str)


def test_windows_stay_exact_with_many_kinds():
    words = [b"w%d" % (i * 7919 % 100000) for i in range(30000)] * 2
    assert rules.repeated_words(words) == len(words)
    assert rules.repeated_words(words[:30000]) == 0


def test_ablations(spark):
    docs = spark.createDataFrame(table(), "doc_id bigint, text string, kept string, n_words int")
    entries = rules.ledger(docs)
    policy = rules.POLICIES["v1"]
    failed = [r.failed for r in entries.collect()]
    for row in rules.ablations(entries, policy).collect():
        bit = 1 << [r.name for r in rules.RULES].index(row.rule)
        assert row.failing == sum(bool(f & bit) for f in failed)
        assert row.failing_alone == sum(f & policy.mask == bit for f in failed)
        assert row.kept_without == sum(f & policy.mask & ~bit == 0 for f in failed)
    assert [r.failing for r in rules.ablations(entries.limit(0)).collect()] == [0] * len(rules.RULES)


def test_passing_keeps_rows_as_they_are(spark):
    docs = spark.createDataFrame(table(), "doc_id bigint, text string, kept string, n_words int")
    good = rules.passing(docs)
    assert good.columns == docs.columns
    assert sorted(r.doc_id for r in good.collect()) == [6, 9, 11, 12]
    assert rules.passing(docs.limit(0)).count() == 0
