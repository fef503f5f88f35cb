"""Tables as named views, and what is in them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.functions.columns import TIMESTAMP_FORM
from mercato.store import TABLES, Store

DESCRIPTIONS = {
    "customers": "One row per customer.",
    "orders": "One row per order, with line and unit counts.",
    "online_orders": "Orders that are not point-of-sale.",
    "order_items": "One row per line of an order.",
    "catalog_items": "Lines whose product is in the current catalog.",
    "products": "One row per product, with variant counts and price range.",
    "variants": "One row per product variant.",
    "raw_customers": "Customers export as it is, all text.",
    "raw_orders": "Orders export as it is, all text.",
    "raw_products": "Products export as it is, all text.",
}
OTHER_DESCRIPTION = "Made in this session."
PREVIEW_ROWS = 100


def register_views(
    spark: SparkSession, store: Store, raw: dict[str, DataFrame] | None = None
) -> None:
    """Name the tables and derived views for ``spark.sql``, with the time parser."""
    for name in TABLES:
        store.table(name).createOrReplaceTempView(name)
    store.online_orders().createOrReplaceTempView("online_orders")
    store.catalog_items().createOrReplaceTempView("catalog_items")
    for kind, df in (raw or {}).items():
        df.createOrReplaceTempView(f"raw_{kind}")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION export_ts(s STRING) RETURNS TIMESTAMP_NTZ RETURN"
        f" CASE WHEN substr(s, 1, 19) RLIKE '{TIMESTAMP_FORM}'"
        " THEN try_cast(substr(s, 1, 19) AS TIMESTAMP_NTZ) END"
    )


@contextmanager
def user_database(spark: SparkSession, folder: str) -> Iterator[str]:
    """Within, the session's ``CREATE TABLE``, ``ALTER`` and ``DROP`` work in a database of their own in ``folder``.

    The views stay visible, and the catalog lists both. The database and its tables go at the end,
    whatever happened; the session is then in the database it was in.
    """
    before = spark.catalog.currentDatabase()
    name = f"user_{uuid.uuid4().hex}"
    spark.sql(f"CREATE DATABASE {name} LOCATION '{folder}/{name}'")
    try:
        spark.catalog.setCurrentDatabase(name)
        yield name
    finally:
        spark.catalog.setCurrentDatabase(before)
        spark.sql(f"DROP DATABASE {name} CASCADE")


def load_summary(store: Store) -> DataFrame:
    """Rows per modeled table."""
    counts = [
        store.table(name).agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        for name in TABLES
    ]
    return reduce(DataFrame.unionByName, counts)


def catalog_profile(spark: SparkSession) -> DataFrame:
    """Every view of the session: description, rows, columns and types.

    Known tables come first in a fixed order, then the others by name. A view
    whose source is gone counts zero rows.
    """
    present = {t.name for t in spark.catalog.listTables()}
    known = [name for name in DESCRIPTIONS if name in present]
    parts = []
    for place, name in enumerate([*known, *sorted(present - set(known))]):
        try:
            df = spark.table(f"`{name}`")
            fields = df.schema.fields
            rows = df.agg(F.count("*").alias("row_count"))
        except AnalysisException:
            fields, rows = [], spark.range(1).select(F.lit(0).cast("bigint").alias("row_count"))
        columns = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(f.name).alias("column"),
                    F.lit(f.dataType.simpleString()).alias("type"),
                )
                for i, f in enumerate(fields, 1)
            ]
        ).cast("array<struct<position:int,column:string,type:string>>")
        parts.append(
            rows.select(
                F.lit(place).alias("place"),
                F.lit(name).alias("table"),
                F.lit(DESCRIPTIONS.get(name, OTHER_DESCRIPTION)).alias("description"),
                "row_count",
                F.inline_outer(columns),
            )
        )
    if not parts:
        return spark.createDataFrame(
            [],
            "table string, description string, row_count bigint,"
            " position int, column string, type string",
        )
    return reduce(DataFrame.unionByName, parts).orderBy("place", "position").drop("place")


def table_preview(df: DataFrame) -> DataFrame:
    return df.limit(PREVIEW_ROWS)


