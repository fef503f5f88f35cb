"""Products bought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercato.operators.joins import spread_join
from mercato.operators.ranking import Key, rank_rows
from mercato.session import checkpoint

#: Products of a basket are paired in lists of about this many.
BLOCK = 256


def pair_counts(baskets: DataFrame, min_together: int) -> DataFrame:
    """Pairs a < b with at least ``min_together`` shared baskets.

    ``baskets`` holds distinct (order_name, lineitem_name). Result: ``a``,
    ``b``, ``together``, ``baskets_of_a``; every qualifying pair, exactly.
    """
    baskets = baskets.filter(F.col("order_name").isNotNull() & F.col("lineitem_name").isNotNull())
    frequent = baskets.groupBy("lineitem_name").agg(F.count("*").alias("baskets"))
    frequent = frequent.filter(F.col("baskets") >= min_together)
    products = number_products(frequent.select("lineitem_name"))
    numbered = spread_join(baskets, products, "lineitem_name").select("order_name", "product")
    return numbered_pair_counts(numbered, products, min_together)


def number_products(names: DataFrame) -> DataFrame:
    """Distinct ``lineitem_name`` with a number each, ``product``, stored."""
    return checkpoint(names.withColumn("product", F.monotonically_increasing_id()))


def extended_numbers(names: DataFrame, numbered: DataFrame) -> DataFrame:
    """``numbered`` (product, lineitem_name) and, numbered on from there, the names it lacks."""
    known = checkpoint(numbered)
    new = checkpoint(names.join(known.select("lineitem_name"), "lineitem_name", "left_anti"))
    after = (known.agg(F.max("product")).first()[0] or 0) + F.col("row_number")
    added = rank_rows(new, [Key("lineitem_name")]).select(after.alias("product"), "lineitem_name")
    return known.select("product", "lineitem_name").unionByName(added)


def numbered_pair_counts(baskets: DataFrame, products: DataFrame, min_together: int) -> DataFrame:
    """:func:`pair_counts` of distinct (order_name, product) without nulls.

    * A product in fewer than ``min_together`` baskets is in no result pair.
    * A pair in ``min_together`` baskets is in at least one basket other than
      the ``min_together - 1`` largest. Those are set aside: they propose no
      pairs, and their support is added to proposed pairs by what each product is held by.
    * A basket is cut into lists of about ``BLOCK`` products, and each pair of lists
      is one row, so a very large basket is paired by many tasks.
    """
    baskets = checkpoint(baskets)
    frequent = baskets.groupBy("product").agg(F.count("*").alias("baskets"))
    frequent = frequent.filter(F.col("baskets") >= min_together).select("product")
    kept = checkpoint(spread_join(baskets, frequent, "product", "left_semi"))
    sizes = kept.groupBy("order_name").agg(F.count("*").alias("size"))
    largest = sizes.orderBy(F.col("size").desc(), "order_name").limit(min_together).collect()
    names = [r["order_name"] for r in largest[: min_together - 1]]
    # Baskets of more than one list, of which there are few, or none if the next in size has but one.
    several = len(largest) == min_together and largest[-1]["size"] > BLOCK
    large = checkpoint(sizes.filter(F.col("size") > BLOCK)) if several else None
    set_aside = F.col("order_name").isin(names)
    held = _held(kept.filter(set_aside), names)

    others = spread_join(kept.filter(~set_aside), held, "product", "left")
    result = _pairs(others, large).filter(F.col("together") >= min_together)
    # All rows of a frequent product are kept.
    counted = kept.groupBy("product").agg(F.count("*").alias("baskets"))
    named = spread_join(products, counted, "product")
    for side in ("x", "y"):
        mine = named.select(
            F.col("product").alias(side),
            F.col("lineitem_name").alias(f"{side}_name"),
            F.col("baskets").alias(f"{side}_baskets"),
        )
        # Sizes are not estimated through an explode: never broadcast what follows one.
        result = spread_join(result.hint("merge"), mine, side)
    x_first = F.col("x_name") < F.col("y_name")
    return result.select(
        F.least("x_name", "y_name").alias("a"),
        F.greatest("x_name", "y_name").alias("b"),
        "together",
        F.when(x_first, F.col("x_baskets")).otherwise(F.col("y_baskets")).alias("baskets_of_a"),
    )


def _held(baskets: DataFrame, names: list) -> DataFrame:
    """Per product the places in ``names`` of the baskets that hold it, ``held``."""
    known = F.array(*[F.lit(n) for n in names]).cast(f"array<{baskets.schema['order_name'].dataType.simpleString()}>")
    place = F.array_position(known, F.col("order_name")).cast("int")
    return baskets.groupBy("product").agg(F.collect_set(place).alias("held"))


def _pairs(baskets: DataFrame, large: DataFrame | None) -> DataFrame:
    """How many baskets hold both ``x`` and ``y``, for each pair x < y that one of ``baskets`` holds.

    The set-aside baskets in ``held`` count too. Each row of a basket brings what its product is held
    by, so no join meets the pairs, which are many more than the rows.
    """
    product = F.struct("product", "held").alias("product")
    lists = F.lit(1)
    if large is not None:
        long = large.select("order_name", F.ceil(F.col("size") / BLOCK).cast("int").alias("lists"))
        baskets = spread_join(baskets, long, "order_name", "left")
        lists = F.coalesce("lists", F.lit(1))
    sized = baskets.select("order_name", product, lists.alias("lists"))
    own = F.pmod(F.xxhash64("product.product"), F.col("lists")).cast("int")
    listed = sized.groupBy("order_name", "lists", own.alias("list")).agg(
        F.sort_array(F.collect_list("product")).alias("products")
    )
    # A pair lies within one list, or in two lists of its basket.
    later = F.slice("products", F.col("i") + 2, F.size("products"))
    pairs = listed.select("products", F.posexplode("products").alias("i", "x")).select(
        "x", F.explode(later).alias("y")
    )
    if large is not None:
        several = listed.filter(F.col("lists") > 1)
        later_lists = F.filter(F.sequence(F.lit(0), F.col("lists") - 1), lambda k: k > F.col("list"))
        others = several.select(
            "order_name", F.col("products").alias("mine"), F.explode(later_lists).alias("list")
        )
        met = others.hint("merge").join(several.drop("lists"), ["order_name", "list"])
        one = met.select(F.explode("mine").alias("p"), "products")
        across = one.select("p", F.explode("products").alias("q")).select(
            F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y")
        )
        pairs = pairs.unionByName(across)
    both = F.size(F.array_intersect("x.held", "y.held"))
    shared = F.when(F.col("x.held").isNotNull() & F.col("y.held").isNotNull(), both).otherwise(0)
    return (
        pairs.select(F.col("x.product").alias("x"), F.col("y.product").alias("y"), shared.alias("shared"))
        .groupBy("x", "y")
        .agg((F.count("*") + F.max("shared")).alias("together"))
    )
