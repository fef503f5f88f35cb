"""Large exports split by quotes, against Spark's reader of whole files and Python's own."""

import csv
import gzip
import io
import random

import pytest

from conftest import spark_rows
from mercato.sources.exports import headers_of, read_export
from mercato.sources.split_csv import quoted_after
from test_plans import settings

HEADER = '﻿Handle,"Body, ""html""",Variant Price,Note\n'
PIECES = [
    "plain", "", '""', '"quoted"', '"a, b"', '"say ""hi"""', '"two\nlines"', '"""\n"""', '"\n\n\n"', '"end""\n,""x"', "5 in",
    '"long ' + "text, with breaks\n" * 30 + '"',
]


def made(seed, rows=400, end="\n"):
    pick = random.Random(seed)
    text = HEADER
    for i in range(rows):
        text += ",".join([f"h{i}", *(pick.choice(PIECES) for _ in range(2)), f'"{i}"']) + "\n"
        if pick.random() < 0.05:
            text += "\n"
    return text.replace("\n", end)


def both(spark, path, size):
    files = headers_of(spark, [str(path)])
    whole = read_export(spark, files, split_above=1 << 40)
    with settings(spark, **{
        "spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1",
    }):
        split = read_export(spark, files, split_above=0)
        tasks = split.rdd.getNumPartitions() - 1
        return spark_rows(whole), spark_rows(split), tasks


@pytest.mark.parametrize("size", [64, 700, 5000, 1 << 30])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equals_the_reader_of_whole_files(spark, tmp_path, size, end):
    text = made(size, rows=60 if size == 64 else 400, end=end)
    (tmp_path / "x.csv").write_bytes(text.encode())
    whole, split, tasks = both(spark, tmp_path / "x.csv", size)
    assert split == whole
    assert tasks > 4 or size == 1 << 30
    rows = [r for r in csv.reader(io.StringIO(text.removeprefix("﻿"), newline="")) if r]
    assert len(split[1]) == len(rows) - 1


def test_quotes_inside_plain_and_quoted_fields(spark, tmp_path):
    rows = ['1,5" nail,x,"a"', '2,"ab"c,"d\ne",f', '3,a"b"c",,', '4,"x" y,"z,\n""w""",1', '5,"q"', "6,a,b,c,d", " ,7"]
    (tmp_path / "x.csv").write_text(HEADER + "\n".join(rows * 40), encoding="utf-8")
    whole, split, _ = both(spark, tmp_path / "x.csv", 100)
    assert split == whole


def test_a_quote_that_is_never_closed(spark, tmp_path):
    (tmp_path / "x.csv").write_text(HEADER + "a,b,c,d\n" * 40 + '1,"open\n' + "e,f,g,h\n" * 40, encoding="utf-8")
    whole, split, _ = both(spark, tmp_path / "x.csv", 100)
    assert len(split[1]) == len(whole[1]) == 41


def test_header_only_and_header_over_several_ranges(spark, tmp_path):
    long = '"Handle","' + "\n".join(["line"] * 50) + '",Variant Price\n'
    for name, text in (("none.csv", long), ("some.csv", long + '1,"2\n3",4\n5,6,7\n')):
        (tmp_path / name).write_text(text)
        whole, split, _ = both(spark, tmp_path / name, 40)
        assert split == whole


def test_several_files_in_one_task(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"x{i}.csv").write_bytes(made(i, rows=50).encode())
    files = headers_of(spark, str(tmp_path))
    assert spark_rows(read_export(spark, files, split_above=0)) == spark_rows(read_export(spark, files))


def test_compressed_files_are_read_once_without_a_scan(spark, tmp_path):
    open_quote = HEADER + "a,b,c,d\n" * 40 + '1,"open\n' + "e,f,g,h\n" * 40
    texts = [made(1, rows=50), made(2, rows=50, end="\r\n"), HEADER, HEADER + '1,"x""\ny",5 in,', open_quote]
    for i, text in enumerate(texts):
        (tmp_path / f"x{i}.csv").write_bytes(text.encode())
        (tmp_path / f"x{i}.csv.gz").write_bytes(gzip.compress(text.encode()))
    header = next(iter(headers_of(spark, [str(tmp_path / "x0.csv")]).values()))
    plain, packed = ({str(tmp_path / f"x{i}.csv{end}"): header for i in range(len(texts))} for end in ("", ".gz"))
    split = read_export(spark, packed, split_above=0)
    assert spark_rows(split) == spark_rows(read_export(spark, plain, split_above=0))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == plan.count("Scan text") == 1 and "Exchange" not in plan


@pytest.mark.parametrize("end", ["", ".gz"])
@pytest.mark.parametrize("kept", [["Note", "Handle"], ["Variant Price"], ["no such"]])
def test_only_the_columns_asked_for_leave_python(spark, tmp_path, end, kept):
    rows = ['1,5" nail,x,"a"', '2,"ab"c,"d\ne",f', '5,"q"', "6,a,b,c,d", '7,"a\nb",c,d']
    text = (HEADER + "\n".join(rows * 40)).encode()
    (tmp_path / f"x.csv{end}").write_bytes(gzip.compress(text) if end else text)
    files = headers_of(spark, str(tmp_path))
    split, whole = (read_export(spark, files, split_above=above, kept=kept) for above in (0, 1 << 40))
    every = read_export(spark, files, split_above=0)
    assert split.columns == whole.columns == [c for c in every.columns if c in kept]
    assert split.count() == whole.count() == every.count()
    assert not split.columns or spark_rows(split) == spark_rows(whole) == spark_rows(every.select(*split.columns))


@pytest.mark.parametrize("line, plain, quoted", [
    ("a,b", False, True), ('a,"b', True, False), ('"', True, False), ('""', False, True), ('a"b,c', False, False),
    ('x",y', False, False), ('x","y', True, True), ('"a""', True, False), ('"a"b,"c', True, True), ('"a"\r', False, False),
])
def test_state_at_the_end_of_a_line(line, plain, quoted):
    assert (quoted_after(line, False), quoted_after(line, True)) == (plain, quoted)
