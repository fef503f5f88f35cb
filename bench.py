"""Time the questions on stored tables, as one JSON line.

The tables are modeled and stored once, then queried many times; the time to
store them is reported apart as ``load``. They lie in BENCH_STORE, or in the shared
folder, and go at the end. Each question runs twice: the second run counts, and
``first_run`` is the total of the first, with code generation and class loading.
``rank_rows_10m`` times global ranks and running totals over ten million rows.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

from pyspark.sql import functions as F

from mercato.operators.ranking import Key, rank_rows
from mercato.queries import ask, names
from mercato.session import build_session, checkpoint, remove_folder, shared_folder
from mercato.sinks.results import read_tables, write_tables
from mercato.sources.sample_tables import AS_OF, SampleStore


def seconds(run) -> float:
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session(
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    stored = f"{os.environ.get('BENCH_STORE') or shared_folder(spark)}/bench-{uuid.uuid4().hex}"
    load = seconds(lambda: write_tables(SampleStore(spark, folder), stored))
    store = read_tables(spark, stored)

    def run(name: str) -> None:
        ask(name, store, AS_OF).write.format("noop").mode("overwrite").save()

    chosen = [n for n in names() if not only or any(n.startswith(p) for p in only)]
    first = {name: seconds(lambda name=name: run(name)) for name in chosen}
    times = {name: seconds(lambda name=name: run(name)) for name in chosen}
    rows = spark.range(10_000_000).select("id", (F.xxhash64("id") % 1000).alias("v"))
    rows, keys = checkpoint(rows), [Key("v", descending=True), Key("id")]
    rank = seconds(lambda: rank_rows(rows, keys, ["v"]).write.format("noop").mode("overwrite").save())
    remove_folder(spark, stored)
    print(
        json.dumps(
            {
                "metric": f"total time of {len(times)} questions",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "first_run": round(sum(first.values()), 3),
                "load": load,
                "rank_rows_10m": rank,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
