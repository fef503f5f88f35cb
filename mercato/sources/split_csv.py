"""CSV files with line breaks inside quotes, read by many tasks each.

Spark splits text into byte ranges, and whether a range begins inside a quoted field depends
on everything before it. So there are two passes.

* A scan: each range is followed from both possible states, between records and inside quotes,
  and reports the state at its end for either, the text up to the first record that begins in it,
  and the record that is open at its end. That is one row a range. A prefix scan over a
  file's ranges then picks the true states and puts together the records that cross ranges.
* All ranges at once give out the records that lie within them.

A compressed file is one range, which begins between records: it needs no scan.

Records are parsed by Arrow, a batch at a time. What Arrow might read in another way than Spark's
parser, odd quotes and records that lack fields or have too many, is left to Spark's parser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import mercato.sources

# Executors need not have this package on their path: its functions travel whole.
cloudpickle.register_pickle_by_value(mercato.sources)

#: How exports are quoted.
FORMAT = {"quote": '"', "escape": '"', "multiLine": "true"}
QUOTE, COMMA, RETURN = b'",\r'
#: Files that Spark does not divide into ranges.
PACKED = ".gz"
#: Lines after which a scan looks whether both states have met.
LOOK = 64


def quoted_after(line: str, quoted: bool) -> bool:
    """Whether the end of a line lies inside a quoted field, given its beginning.

    A quote opens a field only where the field begins, and a quote that neither ends the
    field nor is doubled turns the rest of the field into plain text, as in Spark's parser.
    """
    at = 0
    while True:
        if quoted:
            end = line.find('"', at)
            if end < 0:
                return True
            follows = line[end + 1 : end + 2]
            if follows == '"':
                at = end + 2
                continue
            quoted = False
            at = end + 1
        elif at == 0 and line.startswith('"'):
            quoted, at = True, 1
            continue
        start = line.find(',"', at)
        if start < 0:
            return False
        quoted, at = True, start + 2


def _quoted_after_each(lines: pa.Array, quoted: bool) -> tuple[np.ndarray, bool]:
    """Whether the end of each of some consecutive lines lies inside a quoted field.

    Where every quote opens a field, ends one or is doubled, the parity of the quotes tells. Other
    lines are followed one by one. The second result says whether the quotes were regular.
    """
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)
    at = np.flatnonzero(data[offsets[0] : offsets[-1]] == QUOTE) + offsets[0]
    before = np.searchsorted(at, offsets)
    if not len(at):
        return np.full(len(lines), quoted), True
    line = np.searchsorted(offsets, at, "right") - 1
    starts, ends = offsets[line], offsets[line + 1]
    previous = np.where(at > starts, data[np.maximum(at, 1) - 1], COMMA)
    following = np.where(at + 1 < ends, data[np.minimum(at + 1, len(data) - 1)], COMMA)
    last = (following == RETURN) & (at + 2 == ends)
    opens = (np.arange(len(at)) + quoted) % 2 == 0
    neighbour = np.where(opens, previous, following)
    if np.all((neighbour == COMMA) | (neighbour == QUOTE) | (last & ~opens)):
        return (before[1:] + quoted) % 2 == 1, True
    states = []
    for text in lines.to_pylist():
        quoted = quoted_after(text, quoted) if '"' in text else quoted
        states.append(quoted)
    return np.array(states, bool), False


class _Records:
    """The records of a byte range from one state at its beginning."""

    def __init__(self, quoted: bool):
        self.quoted = quoted
        #: Lines of the record that was open at the beginning, and whether it has ended.
        self.head: list[str] = []
        self.closed = not quoted
        #: Lines of the record that is open.
        self.open: list[str] = []
        self.whole = 0
        #: Whether the quotes of the last records, and of the open one, were regular.
        self.regular = self.regular_open = True

    def add(self, lines: pa.Array) -> pa.Array:
        """The records that end with one of ``lines``, but for that of an earlier range."""
        after, regular = _quoted_after_each(lines, self.quoted)
        self.regular = regular and self.regular_open
        self.regular_open = regular if not after[-1] else self.regular
        self.quoted = bool(after[-1])
        ends = np.flatnonzero(~after) + 1
        if not self.closed:
            upto = int(ends[0]) if len(ends) else len(lines)
            self.head += lines[:upto].to_pylist()
            self.closed = bool(len(ends))
            lines, ends = lines[upto:], ends[1:] - upto
        if not len(ends):
            self.open += lines.to_pylist()
            return pa.array([], pa.string())
        cuts = np.concatenate([[0], ends]).astype(np.int32)
        records = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), lines[: cuts[-1]]), "\n")
        if self.open:
            first = pa.array(["\n".join([*self.open, records[0].as_py()])])
            records = pa.concat_arrays([first, records[1:]])
        self.open = lines[cuts[-1] :].to_pylist()
        self.whole += len(records)
        return records

    @property
    def tail(self) -> str | None:
        return "\n".join(self.open) if self.open else None


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.Array, int]]:
    """Neighbouring lines of one range: (path, start), the lines, and the first one's place."""
    starts = batch.column("start").to_numpy(zero_copy_only=False)
    paths = batch.column("path").dictionary_encode().indices.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero((np.diff(starts) != 0) | (np.diff(paths) != 0)) + 1
    values = batch.column("value").cast(pa.string())
    for first, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
        key = (batch.column("path")[first].as_py(), int(starts[first]))
        yield key, values[first:end], first


class _Scan:
    """What a byte range is from either state."""

    def __init__(self, key: tuple[str, int], returns: bool):
        self.key, self.returns = key, returns
        self.plain, self.quoted = _Records(False), _Records(True)
        #: Once both are between records, they stay alike.
        self.same = False

    def add(self, lines: pa.Array) -> None:
        while len(lines):
            # They meet soon or never: look often at first.
            some = lines if self.same else lines[:LOOK]
            self.plain.add(some)
            if not self.same:
                self.quoted.add(some)
                self.same = self.quoted.closed and not (self.plain.quoted or self.quoted.quoted)
            lines = lines[len(some) :]

    def row(self) -> pa.RecordBatch:
        late = self.plain if self.same else self.quoted
        values = {
            "path": self.key[0],
            "start": self.key[1],
            "plain_after": self.plain.quoted,
            "quoted_after": late.quoted,
            "plain_tail": self.plain.tail,
            "quoted_tail": late.tail,
            "head": "\n".join(self.quoted.head),
            "plain_whole": self.plain.whole,
            "returns": self.returns,
        }
        return pa.RecordBatch.from_pylist([values], schema=_SCANNED)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a range."""
    here = None
    for batch in batches:
        if not batch.num_rows:
            continue
        for key, lines, _ in _runs(batch):
            if here is None or key != here.key:
                if here:
                    yield here.row()
                here = _Scan(key, lines[0].as_py().endswith("\r"))
            here.add(lines)
    if here:
        yield here.row()


_SCANNED = pa.schema(
    [
        ("path", pa.string()),
        ("start", pa.int64()),
        ("plain_after", pa.bool_()),
        ("quoted_after", pa.bool_()),
        ("plain_tail", pa.string()),
        ("quoted_tail", pa.string()),
        ("head", pa.string()),
        ("plain_whole", pa.int64()),
        ("returns", pa.bool_()),
    ]
)
_SCANNED_DDL = (
    "path string, start bigint, plain_after boolean, quoted_after boolean, plain_tail string,"
    " quoted_tail string, head string, plain_whole bigint, returns boolean"
)


def _parsed(records: pa.Array, names: Sequence[str], kept: Sequence[str]) -> list[pa.Array] | None:
    """The ``kept`` columns of records as text; None if some have more fields than names, or fewer."""
    odd = []

    def skip(row) -> str:
        odd.append(row)
        return "skip"

    text = "\n".join(records.to_pylist()).encode()
    found = csv.read_csv(
        pa.BufferReader(text),
        csv.ReadOptions(use_threads=False, block_size=len(text) + 1, column_names=names),
        csv.ParseOptions(newlines_in_values=True, invalid_row_handler=skip),
        csv.ConvertOptions(
            check_utf8=False,
            column_types={n: pa.string() for n in kept},
            # None would be all.
            include_columns=kept or names[:1],
            null_values=[""],
            strings_can_be_null=True,
            quoted_strings_can_be_null=True,
        ),
    )
    if odd or found.num_rows != len(records):
        return None
    return [c.combine_chunks() for c in found.columns[: len(kept)]]


def _within(
    width: int, kept: Sequence[int], whole: bool = False
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The records that begin and end in one range, without the header, parsed or as they are.

    Parsed records have the columns in the places ``kept``. With ``whole`` a range is a file, and the
    record that is open at its end is the last one.
    """
    names = [f"c{i}" for i in range(width)]
    own = [names[i] for i in kept]

    def given(records: pa.Array, returns: bool, regular: bool) -> Iterator[pa.RecordBatch]:
        if returns:
            records = pc.replace_substring(records, "\r\n", "\n")
            records = pc.replace_substring_regex(records, r"\r\z", "")
        records = records.filter(pc.not_equal(records, ""))
        if not len(records):
            return
        fields = _parsed(records, names, own) if regular else None
        if fields is None:
            fields = [pa.nulls(len(records), pa.string())] * len(own)
        else:
            records = pa.nulls(len(records), pa.string())
        yield pa.RecordBatch.from_arrays([records, *fields], names=["record", *own])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, returns = None, _Records(False), False

        def last() -> Iterator[pa.RecordBatch]:
            # Where no record is whole, it is the header that is open.
            if whole and state.open and state.whole:
                yield from given(pa.array([state.tail]), returns, regular=False)

        for batch in batches:
            if not batch.num_rows:
                continue
            for now, lines, first in _runs(batch):
                if now != key:
                    yield from last()
                    quoted = False if whole else batch.column("quoted")[first].as_py()
                    if quoted is None:
                        raise RuntimeError(f"the byte ranges of {now[0]} changed between two reads")
                    key, state = now, _Records(quoted)
                    returns = lines[0].as_py().endswith("\r") if whole else batch.column("returns")[first].as_py()
                before = state.whole
                records = state.add(lines)
                if before == 0 and key[1] == 0:
                    records = records[1:]
                yield from given(records, returns, state.regular)
        yield from last()

    return run


def _xor(a: Column, b: Column) -> Column:
    return a.cast("int").bitwiseXOR(b.cast("int"))


def _placed(ranges: DataFrame) -> DataFrame:
    """Ranges with ``quoted``, their true state at the beginning, and what follows from it.

    A range that ends alike from both states settles the state; between two such ranges it
    changes with every range that turns one state into the other.
    """
    by_start = Window.partitionBy("path").orderBy("start")
    earlier = by_start.rowsBetween(Window.unboundedPreceding, -1)
    settled = F.col("plain_after") == F.col("quoted_after")
    turns = (F.col("plain_after") & ~F.col("quoted_after")).cast("int")
    counted = ranges.withColumn("turns", F.sum(turns).over(by_start.rowsBetween(Window.unboundedPreceding, 0)) % 2)
    known = counted.select(
        "*",
        F.when(settled, _xor(F.col("plain_after"), F.col("turns"))).alias("settled"),
        F.lag("turns", 1, 0).over(by_start).alias("turned"),
    )
    last = F.coalesce(F.last("settled", ignorenulls=True).over(earlier), F.lit(0))
    placed = known.withColumn("quoted", _xor(last, F.col("turned")) == 1)
    tail = F.when(F.col("quoted"), F.col("quoted_tail")).otherwise(F.col("plain_tail"))
    first = F.first("returns").over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    owned = placed.withColumn("tail", tail).withColumn("returns", first)
    owner = F.last(F.when(F.col("tail").isNotNull(), F.col("start")), ignorenulls=True).over(earlier)
    return owned.withColumn("owner", owner)


def _crossing(placed: DataFrame) -> DataFrame:
    """The records that begin in one range and end in a later one, without the header."""
    # Where the header is open at the end of the first range, it is no record.
    header = (F.col("start") == 0) & (F.col("plain_whole") == 0)
    begun = placed.filter(F.col("tail").isNotNull()).select(
        "path", F.col("start").alias("owner"), "start", F.col("tail").alias("text"), header.alias("header"), "returns"
    )
    going_on = placed.filter("quoted").select(
        "path", "owner", "start", F.col("head").alias("text"), F.lit(False).alias("header"), "returns"
    )
    pieces = F.transform(F.sort_array(F.collect_list(F.struct("start", "text"))), lambda p: p["text"])
    whole = begun.unionByName(going_on).groupBy("path", "owner").agg(
        F.array_join(pieces, "\n").alias("record"),
        F.bool_or("header").alias("header"),
        F.bool_or("returns").alias("returns"),
    )
    breaks = F.regexp_replace("record", r"\r(\n|\z)", "$1")
    return whole.filter(~F.col("header")).select(F.when(F.col("returns"), breaks).otherwise(F.col("record")).alias("record"))


def read_split(
    spark: SparkSession, paths: Sequence[str], columns: Sequence[str], kept: Sequence[str] | None = None
) -> DataFrame:
    """The records of CSV files with one header, as text columns: all, or those ``kept``.

    Records end with a line feed. Where a carriage return precedes the first one of a file, pairs
    of both are line breaks in that file, inside quotes too. Empty records are left out. A quote
    that is never closed makes the rest of its file one record.
    """
    names = [f"c{i}" for i in range(len(columns))]
    places = [i for i, c in enumerate(columns) if kept is None or c in kept]
    fields = ", ".join(f"{n} string" for n in names)
    found = ", ".join(["record string", *[f"{names[i]} string" for i in places]])

    def lines(some: list[str]) -> DataFrame:
        return spark.read.option("lineSep", "\n").text(some).select(
            F.make_valid_utf8("value").alias("value"),
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_block_start").alias("start"),
        )

    parts = []
    packed = [p for p in paths if p.endswith(PACKED)]
    if packed:
        # What tells files apart is beside each line: a number is short.
        told = lines(packed).withColumn("path", F.xxhash64("path"))
        parts.append(told.mapInArrow(_within(len(names), places, whole=True), found))
    plain = [p for p in paths if not p.endswith(PACKED)]
    if plain:
        placed = _placed(lines(plain).mapInArrow(_scan, _SCANNED_DDL))
        # One row a range, of spark.sql.files.maxPartitionBytes each.
        states = F.broadcast(placed.select("path", "start", "quoted", "returns"))
        stated = lines(plain).join(states, ["path", "start"], "left")
        parts.append(stated.mapInArrow(_within(len(names), places), found))
        parts.append(_crossing(placed).filter(F.col("record") != ""))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    unparsed = F.when(F.col("record").isNotNull(), F.from_csv("record", fields, FORMAT))
    none = F.lit(None).cast("string")
    parsed = F.struct(*[F.col(n) if i in places else none.alias(n) for i, n in enumerate(names)])
    row = F.coalesce(unparsed, parsed).alias("row")
    return every.select(row).select(*[F.col(f"row.{names[i]}").alias(columns[i]) for i in places])


def file_sizes(spark: SparkSession, paths: Sequence[str]) -> Mapping[str, int]:
    """Bytes of each file, by one listing of each folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    wanted = {path: jvm.org.apache.hadoop.fs.Path(path) for path in paths}
    sizes: dict[str, dict[str, int]] = {}
    for path in wanted.values():
        folder = path.getParent()
        if folder.toString() not in sizes:
            listed = folder.getFileSystem(conf).listStatus(folder)
            sizes[folder.toString()] = {s.getPath().getName(): s.getLen() for s in listed}
    return {path: sizes[at.getParent().toString()][at.getName()] for path, at in wanted.items()}
