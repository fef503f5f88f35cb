"""Run stages one after another through stored tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from mercato.session import remove_folder, shared_folder


def run_stages(
    spark: SparkSession,
    docs: DataFrame,
    folder: str,
    stages: Sequence[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]],
) -> DataFrame:
    """The last stage's rows; each stage is stored as Parquet and read by the next.

    The tables lie in a folder of this run under the shared folder, which all
    executors read and write. A stage's table goes once the next one is stored; the
    last stays, as the result reads it.
    """
    run = f"{shared_folder(spark)}/stages-{uuid.uuid4().hex}"
    before = None
    for number, (name, stage) in enumerate(stages, start=1):
        path = f"{run}/{number}-{name}"
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove_folder(spark, before)
        before = path
    return docs
