import datetime as dt
import random
import re

import duckdb

from mercato.llm import oracle, url_lists

DAY = dt.date(2024, 1, 1)


def day(n):
    return DAY + dt.timedelta(days=n)


def brute_active(events, name, entry, at):
    on = False
    for d in sorted({e[3] for e in events if e[0] == name and e[1].lower().rstrip("/") == entry}):
        if d > at:
            break
        actions = {e[2] for e in events if e[0] == name and e[1].lower().rstrip("/") == entry and e[3] == d}
        on = "add" in actions or (on and "remove" not in actions)
    return on


def brute(url, at, events, allow=("allow",)):
    found = set()
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)[^/?#]*([^?#]*)", (url or "").lower())
    if m and at:
        host = [p for p in m[1].rstrip(".").split(".") if p]
        path = [p for p in m[2].split("/") if p]
        keys = [
            ".".join(host[i:]) + "".join("/" + p for p in path[:n]) for i in range(len(host)) for n in range(len(path) + 1)
        ]
        names = {(e[0], e[1].lower().rstrip("/")) for e in events if e[1] and e[2] in ("add", "remove") and e[3]}
        clean = [e for e in events if e[1] and e[2] in ("add", "remove") and e[3] and e[0]]
        found = {n for n, entry in names if entry in keys and brute_active(clean, n, entry, at)}
    return sorted(found), bool(found) and not found & set(allow)


def test_as_of_equals_brute_force(spark):
    rng = random.Random(3)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "B.org", "c.net:80", "u:p@d.io", "com", ""]
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(hosts)}{rng.choice(['', '/', '/p', '/p/q/', '/P?z=/k', '//p#/x'])}" for _ in range(300)]
    urls += ["//a.com/p", "ftp://x.a.com./p", "no url", "", None, "http://a.com/" + "s/" * 3000, "http://" + "l." * 500 + "a.com"]
    entries = ["a.com", "x.a.com", "a.com/p", "b.org/p/q", "B.ORG/", "c.net", "d.io", "com", "zzz"]
    events = [
        (rng.choice(["spam", "ads", "allow"]), rng.choice(entries), rng.choice(["add", "add", "remove"]), day(rng.randrange(40)))
        for _ in range(120)
    ]
    events += [("spam", None, "add", DAY), ("spam", "a.com", "what", DAY), ("spam", "a.com", "add", None), (None, "a.com", "add", DAY)]
    captures = [(i, u, day(rng.randrange(-2, 45)), "k", "s") for i, u in enumerate(urls)]
    captures += [(None, "http://a.com", None, None, None), captures[0], captures[0]]
    df = spark.createDataFrame(captures, "page_id int, url string, fetched date, key string, lists string")
    ev = spark.createDataFrame(events, "list string, entry string, action string, day date")
    got = sorted(((r.page_id, r.lists, r.blocked) for r in url_lists.filtered(df, ev).collect()), key=str)
    want = sorted(((i, *brute(u, d, events)) for i, u, d, *_ in captures), key=str)
    assert got == want
    assert {b for *_, b in got} == {True, False} and any("allow" in names for _, names, _ in got)


def test_intervals(spark):
    events = [("s", "A.com/", "add", day(1)), ("s", "a.com", "add", day(2)), ("s", "a.com", "remove", day(3)), ("s", "a.com", "remove", day(3)),
              ("s", "a.com", "remove", day(4)), ("s", "a.com", "add", day(5)), ("s", "a.com", "remove", day(5)), ("s", "b", "remove", day(1))]
    ev = spark.createDataFrame(events, "list string, entry string, action string, day date")
    got = sorted(map(tuple, url_lists.intervals(ev).collect()), key=str)
    assert got == [("s", "a.com", day(1), day(3)), ("s", "a.com", day(5), None)]


def test_empty_lists_and_captures(spark):
    df = spark.createDataFrame([(1, "http://a.com", DAY)], "page_id int, url string, fetched date")
    ev = spark.createDataFrame([("s", "a.com", "add", DAY)], "list string, entry string, action string, day date")
    assert url_lists.filtered(df, ev).first().blocked
    assert not url_lists.filtered(df, ev.limit(0)).first().blocked
    assert url_lists.filtered(df.limit(0), ev).count() == 0


def test_sql_agrees_on_sample_pages(spark):
    folder = "/root/testdata/sf0.001"
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    found = url_lists.filtered(url_lists.sample_captures(pages), url_lists.sample_events(pages))
    got = sorted((r.page_id, r.url, r.fetched, ",".join(r.lists), r.blocked) for r in found.collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    assert sorted(con.execute(oracle.url_filters()).fetchall()) == got
    assert any(r[3] for r in got)


def test_a_url_that_is_captured_very_often_is_split(spark):
    from test_plans import SKEW, plan_of, settings

    df = spark.range(60_000).repartition(8).selectExpr(
        "id page_id", "if(id % 2 = 0, 'http://hot.com/', concat('http://h', id % 3000, '.com/')) url",
        "date'2024-05-01' fetched", "xxhash64(id) filler",
    )
    ev = spark.createDataFrame([("s", "hot.com", "add", DAY)], "list string, entry string, action string, day date")
    with settings(spark, **SKEW):
        found = url_lists.filtered(df, ev)
        assert sum(r.blocked for r in found.collect()) == 30_000
        assert "skew=true" in plan_of(found)
