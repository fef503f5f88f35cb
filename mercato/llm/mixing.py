"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled and queued, up to ``REPEATS`` times over. A
document's virtual finish time is the number of its source's words queued up to its
end, divided by the source's target. All documents are then sorted by finish time
and taken until the total budget is spent, so every source gets words at the
rate of its target. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import SPACES
from mercato.operators.joins import spread_join
from mercato.operators.ranking import Key, rank_rows
from mercato.session import checkpoint

#: Weights of the sources in order, over and over.
WEIGHTS = (5, 2, 1)
#: A document may be taken so many times.
REPEATS = 3


def count_words(text: Column) -> Column:
    """Words of a text between blanks; null and empty texts have none."""
    bounded = F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " "))
    # One blank is left between two words.
    blanks = F.length(bounded) - F.length(F.replace(bounded, F.lit(" "), F.lit("")))
    return F.when(F.length(bounded) == 0, 0).otherwise(blanks + 1).cast("bigint")


def targets(sources: DataFrame, repeats: int = REPEATS) -> DataFrame:
    """``sources`` (size, weight, ...) with ``target``, in words; all sizes are shared out.

    A share is proportional to the weight and at most ``repeats`` times the size. What a source
    leaves goes to the others by weight, until no share is above its bound. Only two totals of
    each round come to the driver. Sizes that add up to nothing give targets of zero. ``sources``
    is read several times; give it a stored table or a checkpoint.
    """
    cap, weight = F.col("size") * repeats, F.col("weight")
    total = sources.agg(F.sum("size").alias("rest"), F.sum("weight").alias("weights")).first()
    rest, weights = total["rest"] or 0, total["weights"] or 0

    def full() -> Column:
        whole = F.lit(rest).cast("decimal(19,0)") * weight.cast("decimal(19,0)")
        return cap.cast("decimal(19,0)") * F.lit(weights).cast("decimal(19,0)") < whole

    while True:
        left = sources.agg(
            F.sum(F.when(full(), cap)).alias("capped"), F.sum(F.when(full(), weight)).alias("weights")
        ).first()
        after = ((total["rest"] or 0) - (left["capped"] or 0), (total["weights"] or 0) - (left["weights"] or 0))
        if after == (rest, weights):
            break
        rest, weights = after
    share = (F.lit(rest) * weight).cast("double") / F.lit(max(weights, 1)).cast("double")
    return sources.withColumn("target", F.when(full(), cap.cast("double")).otherwise(share))


def shuffled_place(key: Column, turn: Column, seed: str) -> Column:
    """A number that puts documents in random order, another one in each turn."""
    text = F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("")), turn.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


def mix(
    docs: DataFrame,
    id: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: Sequence[int] = WEIGHTS,
    repeats: int = REPEATS,
    seed: str = "mix",
) -> DataFrame:
    """What a mix as large as all documents takes of each: a row for every row of ``docs``.

    Columns: the id, ``size``, ``source_size``, ``target`` and ``taken``, in words. Sources are
    ordered by code point, null last, which is a source of its own. The document on which the
    budget ends is taken in part. Every row is a document of its own, repeated ids and nulls too;
    rows of one id are queued in order of their size, so that reruns agree.
    A document without words is taken zero times. An empty table gives no rows.
    """
    has = F.col(f"`{source}`").isNotNull()
    name = F.when(has, F.concat(F.lit("s"), F.col(f"`{source}`").cast("string"))).otherwise(F.lit("t"))
    rows = checkpoint(
        docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(f"`{id}`").alias("id"),
            name.alias("name"),
            count_words(F.col(f"`{text}`")).alias("size"),
        )
    )
    sizes = rows.groupBy("name").agg(F.sum("size").alias("size"))
    ranked = rank_rows(checkpoint(sizes), [Key("name")], ["size"])
    turns = F.array(*[F.lit(w).cast("bigint") for w in weights])
    weight = F.get(turns, ((F.col("row_number") - 1) % len(weights)).cast("int"))
    sources = targets(checkpoint(ranked.withColumn("weight", weight)), repeats)
    # Queues lie one behind the other, so a source's words start where the earlier ones end.
    queues = sources.select(
        "name",
        F.col("size").alias("source_size"),
        "target",
        ((F.col("upto_size") - F.col("size")) * repeats).alias("first"),
    )
    known = spread_join(rows, queues, "name")
    turn = F.explode(F.array(*[F.lit(t) for t in range(repeats)])).alias("turn")
    queued = known.filter(F.col("size") > 0).select(
        "row",
        "id",
        "name",
        "size",
        "source_size",
        "target",
        "first",
        turn,
    )
    queued = checkpoint(queued.withColumn("place", shuffled_place(F.col("id"), F.col("turn"), seed)))
    order = [Key("place"), Key("id"), Key("size"), Key("row")]
    lined_up = rank_rows(queued, [Key("name"), Key("turn"), *order], ["size"])
    finish = (F.col("upto_size") - F.col("first")).cast("double") / F.col("target")
    finished = checkpoint(lined_up.select(*queued.columns, finish.alias("finish")))
    merged = rank_rows(finished, [Key("finish"), Key("name"), Key("turn"), *order], ["size"])
    budget = sources.agg(F.sum("size")).first()[0] or 0
    room = F.lit(budget) - (F.col("upto_size") - F.col("size"))
    taken = F.greatest(F.least(F.col("size"), room), F.lit(0)).cast("bigint")
    columns = ["row", "id", "size", "source_size", "target"]
    copies = merged.select(*columns, taken.alias("taken")).unionByName(
        known.filter(F.col("size") == 0).select(*columns, F.lit(0).cast("bigint").alias("taken"))
    )
    found = copies.groupBy("row").agg(
        *[F.first(c).alias(c) for c in columns[1:]], F.sum("taken").alias("taken")
    )
    return found.select(F.col("id").alias(id), *columns[2:], "taken")
