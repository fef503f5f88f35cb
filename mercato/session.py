"""Session settings and the checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the library expects.

    Adaptive execution does three jobs here: it turns a join into a broadcast
    only after it has measured the side, it splits skewed join partitions, and
    it merges small shuffle partitions.
    """
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        # Call-site capture costs a round trip per column expression.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        # Checkpoint files go when the result that reads them is gone.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **conf,
    }
    builder = SparkSession.builder.appName("mercato")
    if master:
        builder = builder.master(master)
    for name, value in settings.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder, which all executors can read and write.

    It is the one the session names. Only a local session without one gets a
    temporary folder; on a cluster that would not be shared, so it is an error
    there.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="mercato-checkpoint-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Within, rows of very many columns are made by code that the JVM compiles.

    It leaves methods of more than 8,000 bytes interpreted. Spark divides the code of such a step only
    where the limit below tells it that one method would be too long.
    """
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    spark.conf.set(name, "8000")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder in whatever store it lies."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def in_session(spark: SparkSession, df: DataFrame) -> DataFrame:
    """A result of another session as a table of ``spark``'s, through the shared folder.

    The views of the other session stay out of this one.
    """
    folder = f"{shared_folder(spark)}/result-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    found = checkpoint(spark.read.parquet(folder))
    remove_folder(spark, folder)
    return found
