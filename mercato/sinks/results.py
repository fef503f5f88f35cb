"""Results out: capped previews, JSON-safe rows, CSV and stored tables."""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mercato.functions.columns import clock_text
from mercato.operators.baskets import extended_numbers
from mercato.operators.match import with_match
from mercato.plans.model import model
from mercato.session import compiled, remove_folder
from mercato.sinks.versions import current, new_version, tables_of
from mercato.store import (
    LINE_MATCHES,
    MATCH_COLUMNS,
    MATCHED_ITEMS,
    PLACE_DAYS,
    PRODUCT_DAYS,
    PRODUCT_NAMES,
    TABLES,
    Store,
)

ROLLUPS = (PRODUCT_DAYS, PLACE_DAYS)
# Fixed value: rows a preview returns at most.
ROW_CAP = 10_000


@dataclass(frozen=True)
class Preview:
    columns: list[tuple[str, str]]
    rows: list[Row]
    truncated: bool
    elapsed_ms: float


def preview(df: DataFrame, cap: int = ROW_CAP) -> Preview:
    """The first ``cap`` rows, JSON-safe, and whether there are more."""
    start = time.perf_counter()
    rows = json_safe(df.limit(cap + 1)).collect()
    elapsed = round((time.perf_counter() - start) * 1000, 1)
    columns = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return Preview(columns, rows[:cap], len(rows) > cap, elapsed)


def capped(df: DataFrame, cap: int = ROW_CAP) -> DataFrame:
    """The first ``cap`` rows with ``truncated``, whether there are more."""
    more = df.limit(cap + 1).agg(F.count("*").alias("n")).select(F.col("n") > cap).scalar()
    return df.limit(cap).withColumn("truncated", more)


def json_safe(df: DataFrame) -> DataFrame:
    """Columns as plain JSON values.

    Decimals become doubles, non-finite numbers NULL, dates, times and
    intervals text; arrays, structs and maps are handled inside.
    """
    return df.select(
        *[_safe(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def _safe(c: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.DecimalType):
        return c.cast("double")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        finite = ~F.isnan(c) & (F.abs(c) != float("inf"))
        return F.when(finite, c.cast("double"))
    if isinstance(kind, T.TimestampNTZType):
        return clock_text(c)
    if isinstance(kind, T.TimestampType):
        return F.date_format(c, "yyyy-MM-dd HH:mm:ssxx")
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _safe(x, kind.elementType))
    if isinstance(kind, T.StructType):
        fields = [_safe(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    if isinstance(kind, T.MapType):
        keys = F.transform(F.map_keys(c), lambda k: _safe(k, kind.keyType).cast("string"))
        values = F.transform(F.map_values(c), lambda v: _safe(v, kind.valueType))
        return F.map_from_arrays(keys, values)
    if isinstance(kind, (T.BooleanType, T.IntegralType, T.StringType)):
        return c
    return c.cast("string")


def write_csv(df: DataFrame, folder: str) -> None:
    """CSV files with a header; quotes only where needed, NULL as nothing."""
    nested = (T.ArrayType, T.StructType, T.MapType)
    safe = json_safe(df)

    def flat_column(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, nested):
            c = F.to_json(c, {"ignoreNullFields": "false"})
        return c.alias(f.name)

    flat = safe.select(*[flat_column(f) for f in safe.schema.fields])
    flat.write.mode("overwrite").options(
        header=True,
        quote='"',
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(folder)


def write_json(df: DataFrame, folder: str) -> None:
    json_safe(df).write.mode("overwrite").option("ignoreNullFields", False).json(folder)


def _save(df: DataFrame, folder: str) -> None:
    """A stored table: written once and read often, so packed tightly."""
    with compiled(df.sparkSession):
        df.write.option("compression", "zstd").parquet(folder)


def _write(store: Store, folder: str, previous: str | None, rollups: bool) -> None:
    """The modeled tables in ``folder``, with each line's match and product number stored on the line.

    Names keep the numbers that they have in ``previous``.
    """
    spark = store.customers().sparkSession
    for name in TABLES:
        # Lines stay where they are until it is known what they match.
        place = "unmatched_items" if name == "order_items" else name
        _save(store.table(name), f"{folder}/{place}")
    lines = spark.read.parquet(f"{folder}/unmatched_items")
    variants = spark.read.parquet(f"{folder}/variants")
    _save(Store({"order_items": lines, "variants": variants}).line_matches(), f"{folder}/{LINE_MATCHES}")
    matches = spark.read.parquet(f"{folder}/{LINE_MATCHES}")
    if previous:
        numbered = spark.read.parquet(f"{previous}/{PRODUCT_NAMES}")
    else:
        numbered = spark.createDataFrame([], "product bigint, lineitem_name string")
    names = matches.filter("in_catalog").select("lineitem_name").dropna().distinct()
    _save(extended_numbers(names, numbered), f"{folder}/{PRODUCT_NAMES}")
    names = spark.read.parquet(f"{folder}/{PRODUCT_NAMES}")
    _save(with_match(lines, matches, names), f"{folder}/order_items")
    remove_folder(spark, f"{folder}/unmatched_items")
    if rollups:
        stored = _read(spark, folder)
        for name in ROLLUPS:
            _save(getattr(stored, name)(), f"{folder}/{name}")


def write_tables(store: Store, folder: str, rollups: bool = False) -> None:
    """Store the modeled tables once, so that questions read typed columns.

    ``rollups`` also stores the daily sketches that approximate questions unite.
    The catalog match is worked out from the stored lines and stored on them. The load is a new version
    of ``folder``: readers of the one before are not disturbed, and a load that fails changes nothing.
    """
    spark = store.customers().sparkSession
    previous = current(spark, folder)
    with new_version(spark, folder) as version:
        _write(store, version, previous, rollups)


def write_exports(raw: dict[str, DataFrame], folder: str, rollups: bool = False) -> None:
    """Store the raw tables, and the modeled ones worked out from what was stored, as one version.

    The exports are read once; everything after reads Parquet.
    """
    spark = next(iter(raw.values())).sparkSession
    previous = current(spark, folder)
    with new_version(spark, folder) as version:
        for kind, df in raw.items():
            _save(df, f"{version}/raw_{kind}")
        _write(model(_raw(spark, version)), version, previous, rollups)


def _current(spark: SparkSession, folder: str) -> str:
    version = current(spark, folder)
    if version is None:
        raise ValueError(f"no tables are stored in {folder}")
    return version


def _raw(spark: SparkSession, version: str) -> dict[str, DataFrame]:
    return {kind: spark.read.parquet(f"{version}/raw_{kind}") for kind in ("customers", "orders", "products")}


def read_raw(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The stored raw tables of the current version, by kind of export."""
    return _raw(spark, _current(spark, folder))


def read_tables(spark: SparkSession, folder: str) -> Store:
    """The stored tables of the current version; later loads do not change them."""
    return _read(spark, _current(spark, folder))


def _read(spark: SparkSession, version: str) -> Store:
    stored = tables_of(spark, version)
    names = (*TABLES, LINE_MATCHES, PRODUCT_NAMES, *[r for r in ROLLUPS if r in stored])
    tables = {name: spark.read.parquet(f"{version}/{name}") for name in names}
    tables[MATCHED_ITEMS] = tables["order_items"]
    return Store(tables | {"order_items": tables["order_items"].drop(*MATCH_COLUMNS)})


def save_bucketed(store: Store, buckets: int, prefix: str = "") -> None:
    """Store the tables in the session catalog, orders and lines bucketed alike.

    Orders and lines meet on the order name in most product questions; equal
    buckets let Spark join them without a shuffle. An order that holds a large
    share of all lines makes one large bucket, so prefer ``write_tables`` then.
    """
    spark = store.customers().sparkSession
    for name in TABLES:
        writer = store.table(name).write.mode("overwrite").format("parquet")
        if name in ("orders", "order_items"):
            writer = writer.bucketBy(buckets, "order_name").sortBy("order_name")
        writer.saveAsTable(prefix + name)
    matches = Store({name: spark.table(prefix + name) for name in TABLES}).line_matches()
    matches.write.mode("overwrite").format("parquet").saveAsTable(prefix + LINE_MATCHES)


def read_saved(spark: SparkSession, prefix: str = "") -> Store:
    return Store({name: spark.table(prefix + name) for name in (*TABLES, LINE_MATCHES)})


def as_dict(result: Preview) -> dict[str, Any]:
    """A preview as the JSON object a client would get."""
    return {
        "columns": [{"name": n, "type": t} for n, t in result.columns],
        "rows": [list(r) for r in result.rows],
        "row_count": len(result.rows),
        "truncated": result.truncated,
        "elapsed_ms": result.elapsed_ms,
    }
