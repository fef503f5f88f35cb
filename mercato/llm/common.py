"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import mercato.llm

# Executors need not have this package on their path: its functions travel whole.
cloudpickle.register_pickle_by_value(mercato.llm)

#: Spark's regular expression for the words of several operators.
SPACES = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One sample table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns that a result is about to add, in any letter case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def whole_text(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def utf8(name: str = "text") -> Column:
    """The text as UTF-8 bytes, empty for null."""
    return whole_text(name).cast("binary")


def per_text(make: Callable[[], Callable[[bytes], tuple]], fields: dict[str, pa.DataType], ddl: str):
    """An Arrow function that turns each text, as bytes, into a struct.

    ``make`` is called once per task and gives the function for one text.
    Texts go through one by one, so memory holds a batch and one text's words.
    """

    @F.arrow_udf(ddl)
    def run(texts: pa.Array) -> pa.Array:
        one = make()
        rows = [one(t.as_py() or b"") for t in texts]
        columns = list(zip(*rows)) if rows else [()] * len(fields)
        arrays = [pa.array(c, kind) for c, kind in zip(columns, fields.values(), strict=True)]
        return pa.StructArray.from_arrays(arrays, names=list(fields))

    return run


def held_out(name: str = "doc_id") -> Column:
    """Rows that no training may use: crc32 of the id as text is divisible by 5.

    A null id has no checksum; such a row is never held out and never trained on.
    """
    return F.coalesce(F.crc32(F.col(f"`{name}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def share(spark: SparkSession, **data):
    """Broadcast plain data, which tasks can read without this package."""
    return spark.sparkContext.broadcast(data)


def made_once(shared, make: Callable):
    """What ``make`` gives for the shared data, kept in the worker process for its next tasks."""
    data = shared.value
    if "made" not in data:
        data["made"] = make(**data)
    return data["made"]
