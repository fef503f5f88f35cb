"""Finding and reading the CSV exports.

Exports are told apart by their header, not their file name, and read as
text; the model gives the columns their types.
"""

from __future__ import annotations

import csv
import warnings
from collections.abc import Iterable, Iterator, Mapping
from contextlib import contextmanager
from functools import reduce
from urllib.parse import unquote

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.plans.model import model
from mercato.session import compiled
from mercato.sources.split_csv import FORMAT, file_sizes, read_split
from mercato.store import Store

# Two headers that give each kind of export away.
SIGNATURES = {
    "customers": {"Customer ID", "Total Spent"},
    "orders": {"Lineitem name", "Financial Status"},
    "products": {"Handle", "Variant Price"},
}

#: Files of an export, plain or compressed.
FILES = "*.csv{,.gz}"
#: Records of a compressed file, which one task reads.
FILE_RECORDS = 500_000
#: Lines within which the first record of a file ends.
HEADER_LINES = 10_000


def kind_of(header: Iterable[str]) -> str | None:
    names = set(header)
    return next((kind for kind, both in SIGNATURES.items() if both <= names), None)


@contextmanager
def _one_task_per_file(spark: SparkSession) -> Iterator[None]:
    """Within, a scan gives each file a task of its own, whatever the sizes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(1 << 40))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _first_record(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first CSV record of a file. All is consumed, so that the worker can serve the next file."""
    found = False
    for batch in batches:
        if batch.num_rows and not found:
            found = True
            lines = (line.as_py() + "\n" for line in batch.column(0))
            header = next(csv.reader(lines), [])
            header = [name.removeprefix("\ufeff") for name in header[:1]] + header[1:]
            yield pa.RecordBatch.from_arrays(
                [batch.column(1)[:1], pa.array([header], pa.list_(pa.string()))], names=["path", "header"]
            )


def headers_of(spark: SparkSession, paths: str | list[str]) -> dict[str, list[str]]:
    """The headers of CSV files, by path in order, in one job for all files.

    ``paths`` is a folder, for the files directly in it, or a list of files. Empty files are left out.
    """
    reader = spark.read.option("pathGlobFilter", FILES) if isinstance(paths, str) else spark.read
    with _one_task_per_file(spark):
        lines = reader.text(paths).select("value", "_metadata.file_path")
        # A task counts its lines from zero in the lower 33 bits, and has one file.
        line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        found = lines.filter(line < HEADER_LINES).mapInArrow(_first_record, "path string, header array<string>").collect()
    return {path: header for path, header in sorted((unquote(r.path), r.header) for r in found)}


def find_exports(
    spark: SparkSession, folder: str, first_only: bool = False
) -> dict[str, dict[str, list[str]]]:
    """The headers of the CSV files directly in ``folder``, by kind and path, in name order.

    All files of a kind are its parts. ``first_only`` takes one file of each kind
    and reports the others. A missing kind is an error.
    """
    try:
        headers = headers_of(spark, folder)
    except AnalysisException as error:
        raise ValueError(f"cannot list {folder}") from error
    found: dict[str, dict[str, list[str]]] = {}
    for path, header in headers.items():
        kind = kind_of(header)
        if kind:
            found.setdefault(kind, {})[path] = header
    missing = [kind for kind in SIGNATURES if kind not in found]
    if missing:
        raise ValueError(f"no {', '.join(missing)} export in {folder}")
    if first_only:
        for kind, files in found.items():
            used, *ignored = files
            if ignored:
                warnings.warn(
                    f"several {kind} exports: using {used}, ignoring {', '.join(ignored)}", stacklevel=2
                )
            found[kind] = {used: files[used]}
    return found


def _columns(header: Iterable[str]) -> list[str]:
    """Column names of a header; empty and repeated names get their place."""
    names = list(header)
    return [
        f"_c{i}" if not name else f"{name}{i}" if names.count(name) > 1 else name
        for i, name in enumerate(names)
    ]


def read_export(
    spark: SparkSession,
    files: Mapping[str, list[str]],
    quoted_newlines: bool = True,
    split_above: int | None = None,
    kept: Iterable[str] | None = None,
) -> DataFrame:
    """All columns as text under their original headers, from files and their headers; or the columns ``kept``.

    Spark's reader gives a file with line breaks inside quotes to one task. Files of more
    than ``split_above`` bytes, by default what Spark reads in one task, are therefore split by
    quotes: see :mod:`mercato.sources.split_csv`, which reads them twice. Pass
    ``quoted_newlines=False`` for exports known to have no such line breaks, and Spark splits them
    as they are. Files may differ in column order.
    """
    if split_above is None:
        split_above = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    sizes = file_sizes(spark, list(files)) if quoted_newlines else {}
    alike: dict[tuple[tuple[str, ...], bool], list[str]] = {}
    for path, header in files.items():
        alike.setdefault((tuple(header), sizes.get(path, 0) > split_above), []).append(path)
    parts = []
    for (header, split), same in alike.items():
        if split:
            parts.append(read_split(spark, same, _columns(header), kept))
            continue
        schema = T.StructType([T.StructField(name, T.StringType()) for name in _columns(header)])
        reader = spark.read.schema(schema).options(header=True, **FORMAT | {"multiLine": quoted_newlines})
        found = reader.csv(same)
        parts.append(found if kept is None else found.select(*[f"`{c}`" for c in found.columns if c in kept]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_export(raw: DataFrame, folder: str) -> None:
    """Add a raw table to the exports in a folder, as compressed CSV files of bounded length.

    Fields repeat much from row to row, so the files are a small part of their text. A compressed
    file is read by one task; the bound gives the readers many.
    """
    options = {"header": True, "quote": '"', "escape": '"', "compression": "gzip"}
    options |= {"maxRecordsPerFile": FILE_RECORDS, "zlib.compress.level": "FOUR"}
    with compiled(raw.sparkSession):
        raw.write.mode("append").options(**options).csv(folder)


def load_exports(
    spark: SparkSession,
    folder: str,
    first_only: bool = False,
    quoted_newlines: bool = True,
    split_above: int | None = None,
) -> tuple[Store, dict[str, DataFrame]]:
    """The modeled tables of the exports in ``folder``, and the raw ones."""
    found = find_exports(spark, folder, first_only)

    def read(kind: str, kept: Iterable[str] | None = None) -> DataFrame:
        return read_export(spark, found[kind], quoted_newlines, split_above, kept)

    raw = {kind: read(kind) for kind in found}
    return model(raw, read), raw
