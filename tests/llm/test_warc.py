import gzip
import hashlib
import os

import duckdb
import pytest

from mercato.llm import oracle, warc

LONG = "<p>" + "copied payload é🙂 " * 20


def rows():
    out = [(i, f"http://x/{i}", f"<html>{i} " + "word " * (i * 7 % 90)) for i in range(200)]
    out += [(300 + i, "http://copy/", LONG) for i in range(20)] + [(5, "http://again/", LONG)]
    out += [(400, None, None), (401, "bad \r\n url", ""), (402, "u", "short"), (403, "u", "short")]
    out += [(500, "u", "y" * 100), (500, "u", "y" * 100), (501, "v", "y" * 100), (502, "w", "z" * 99), (503, "w", "z" * 99)]
    out += [(-(2**62), "low", "l" * 500), (2**62, "high", "h" * 500)]
    return out


def brute(pages):
    groups = {}
    for i, _, html in pages:
        groups.setdefault((html or "").encode(), []).append(i)
    out = []
    for payload, ids in groups.items():
        digest = hashlib.sha256(payload).hexdigest()
        some = [i for i in ids if i is not None]
        first = min(some) if some else None
        taken = False
        for i in sorted(ids, key=lambda v: (v is None, v or 0)):
            response = len(payload) < 100 or (i == first and not taken)
            taken = taken or i == first
            out.append((i, len(payload), digest, "response" if response else "revisit", None if response else first))
    return sorted(out, key=str)


def digest_rows(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_round_trip_equals_brute_force_and_sql(spark, tmp_path):
    pages = spark.createDataFrame([(*r, "s", 1) for r in rows()], "page_id bigint, url string, html string, digest string, shard int")
    folder = str(tmp_path / "warc")
    manifest = warc.write_archives(pages, folder, shard_bytes=20000, roll_bytes=3000).collect()
    found = warc.read_archives(spark, folder)
    got = digest_rows(found)
    assert got == brute(rows())
    payloads = {(r.page_id, bytes(r.payload)) for r in found.collect() if r.record_type == "response"}
    assert payloads <= {(i, (h or "").encode()) for i, _, h in rows()}
    assert len({m.shard for m in manifest}) > 3
    assert len(manifest) > len({m.shard for m in manifest})
    assert sum(m.records for m in manifest) == len(rows())
    for m in manifest:
        data = open(os.path.join(folder, m.file), "rb").read()
        assert hashlib.sha256(data).hexdigest() == m.sha256 and len(data) == m.bytes
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert not [f for f in os.listdir(folder) if f.startswith("_temporary")]
    con = duckdb.connect()
    small = pages.select("page_id", "url", "html").filter("page_id not in (500)").toPandas()  # noqa: F841
    con.execute("CREATE TABLE pages AS SELECT page_id::BIGINT AS page_id, html FROM small")
    want = brute([r for r in rows() if r[0] != 500])
    assert sorted(con.execute(oracle.archives()).fetchall(), key=str) == want


def test_same_bytes_however_the_input_is_dealt(spark, tmp_path):
    pages = spark.createDataFrame(rows(), "page_id bigint, url string, html string")
    one = warc.write_archives(pages, str(tmp_path / "a"), shard_bytes=20000, roll_bytes=3000)
    two = warc.write_archives(pages.repartition(7), str(tmp_path / "b"), shard_bytes=20000, roll_bytes=3000)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_null_and_hot_ids_are_dealt_over_shards(spark, tmp_path):
    pages = [(None, "u", f"null {i} " + "x" * 300) for i in range(60)]
    pages += [(7, "u", f"hot {i} " + "x" * 300) for i in range(60)] + [(None, "u", "n" * 200)] * 3
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    manifest = warc.write_archives(df, str(tmp_path / "w"), shard_bytes=9000).collect()
    assert len({m.shard for m in manifest}) >= 8
    got = digest_rows(warc.read_archives(spark, str(tmp_path / "w")))
    assert got == brute(pages)


def test_empty_and_damaged(spark, tmp_path):
    pages = spark.createDataFrame(rows()[:3], "page_id bigint, url string, html string")
    assert warc.write_archives(pages.limit(0), str(tmp_path / "e")).count() == 0
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0
    folder = str(tmp_path / "d")
    name = warc.write_archives(pages, folder).first().file
    path = os.path.join(folder, name)
    data = open(path, "rb").read()
    open(path, "wb").write(data[:-20])
    with pytest.raises(Exception):
        warc.read_archives(spark, folder).collect()


def test_attempts_that_die_or_come_late_leave_a_whole_file_alone(tmp_path):
    def attempt(name, records):
        roller = warc.Roller(str(tmp_path), name, 1 << 20, warc.DATE, 6)
        for r in records:
            assert list(roller.add(3, r)) == []
        return roller

    members = [warc.record([("X", str(i))], b"block", 6) for i in range(5)]
    (first,) = attempt("1", members).close()
    path = tmp_path / first["file"]
    data = path.read_bytes()
    assert hashlib.sha256(data).hexdigest() == first["sha256"]

    attempt("2", members).file.close()  # dies before it renames
    assert path.read_bytes() == data
    (again,) = attempt("3", members).close()  # ends after the first
    assert again == first and path.read_bytes() == data
    with pytest.raises(OSError, match="not of this archive"):
        list(attempt("4", members[:2]).close())
    assert path.read_bytes() == data


def test_leftovers_of_dead_attempts_go(spark, tmp_path):
    pages = spark.createDataFrame(rows()[:3], "page_id bigint, url string, html string")
    (tmp_path / "_temporary-shard-00000001-00000.warc.gz-99").write_bytes(b"half")
    assert warc.write_archives(pages, str(tmp_path)).count() == 1
    assert not list(tmp_path.glob("_temporary*"))
