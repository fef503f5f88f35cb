"""Matching order lines to the product catalog.

A line matches a variant by SKU, by exact line name, or because the line name
starts with the product title. ``OR`` conditions and ``LIKE`` on data would
give a nested-loop join. Here every way to match is a *lookup*: a kind and one
or two texts. Lines and variants are both listed by lookup, and one equi join
brings them together. Lines are matched once per distinct (sku,
lineitem_name).

Prefixes become lookups by cutting each line name at the lengths that occur
among the titles. A title may hold ``%`` or ``_``, which act as wildcards as
they do in ``LIKE``: such a title is looked up by its text before the first
wildcard, and a pattern then checks the rest. Where less than ``GRAM`` characters precede the
wildcard, an inverted index is used instead: the title is listed under one short fragment of
its literal text, the one that the fewest line names contain, and looked up by the
fragments of the names. A title that no name can match is not listed at all, and only a
title without any literal text is compared with every name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.operators.joins import null_safe_join
from mercato.session import checkpoint

LINE = ["sku", "lineitem_name"]
BOTH, SKU, NAME, TITLE, FRAGMENT = range(5)
#: Characters of a fragment, or as many as the longest literal run of a title has.
GRAM = 4
_LOOKUP = ["kind", "text", "text2"]


def _lookup(kind: int, text: Column, text2: Column | None = None) -> Column:
    """A one-element list, or an empty one where a text is missing."""
    second = F.lit("") if text2 is None else text2
    entry = F.struct(F.lit(kind).alias("kind"), text.alias("text"), second.alias("text2"))
    known = text.isNotNull() & second.isNotNull()
    return F.filter(F.array(F.when(known, entry)), lambda e: e.isNotNull())


def _title_head(title: Column) -> Column:
    return F.regexp_extract(title, "(?s)^[^%_]*", 0)


def _title_pattern(title: Column) -> Column:
    """A regular expression for a title with wildcards; NULL for a plain one."""
    escaped = F.regexp_replace(title, r"([\\.^$|?*+()\[\]{}])", r"\\$1")
    any_text = F.replace(escaped, F.lit("%"), F.lit(".*"))
    pattern = F.concat(F.lit("(?s)^"), F.replace(any_text, F.lit("_"), F.lit(".")))
    return F.when(title.contains("%") | title.contains("_"), pattern)


def _runs(title: Column) -> Column:
    """The literal texts between the wildcards of a title."""
    return F.filter(F.split(title, "[%_]+"), lambda run: run != "")


def _by_fragment(title: Column) -> Column:
    """Whether a title is looked up by a fragment: wildcards come early and there is literal text."""
    wild = title.contains("%") | title.contains("_")
    return wild & (F.length(_title_head(title)) < GRAM) & (F.size(_runs(title)) > 0)


def _grams(text: Column, size: Column) -> Column:
    """The distinct fragments of ``size`` characters of a text."""
    last = F.length(text) - size + 1
    places = F.filter(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: i <= last)
    return F.array_distinct(F.transform(places, lambda i: text.substr(i, size)))


def _fragment_sizes(titles: DataFrame) -> Column:
    """The fragment sizes that titles need, at most ``GRAM``, as one array; none without such titles."""
    longest = F.array_max(F.transform(_runs(F.col("product_title")), F.length))
    sizes = titles.agg(F.collect_set(F.least(longest, F.lit(GRAM))).alias("sizes"))
    return sizes.select("sizes").scalar()


def _early_wildcards(variants: DataFrame) -> DataFrame:
    title = F.col("product_title")
    return variants.filter(title.isNotNull() & _by_fragment(title)).select("product_title").distinct()


def _name_fragments(keys: DataFrame, titles: DataFrame) -> DataFrame:
    """(lineitem_name, text): the fragments of each distinct name, of the sizes that titles need."""
    name = F.col("lineitem_name")
    sized = keys.filter(name.isNotNull()).select("lineitem_name").distinct()
    sized = sized.select("lineitem_name", F.explode(_fragment_sizes(titles)).alias("size"))
    return sized.select("lineitem_name", F.explode(_grams(name, F.col("size"))).alias("text"))


def _rarest_fragments(keys: DataFrame, titles: DataFrame) -> DataFrame:
    """(product_title, text): each title's fragment that the fewest names contain, and at least one does."""
    longest = F.array_max(F.transform(_runs(F.col("product_title")), F.length))
    size = F.least(longest, F.lit(GRAM))
    runs = titles.select("product_title", size.alias("size"), F.explode(_runs(F.col("product_title"))).alias("run"))
    own = runs.select("product_title", F.explode(_grams(F.col("run"), F.col("size"))).alias("text")).distinct()
    wanted = own.select("text").distinct()
    found = _name_fragments(keys, titles).hint("merge").join(wanted, "text", "left_semi")
    counts = found.groupBy("text").agg(F.count("*").alias("names"))
    # A fragment that no name has rules its title out.
    counted = own.hint("merge").join(counts, "text", "left")
    best = counted.groupBy("product_title").agg(
        F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "text")).alias("best")
    )
    return best.filter(F.col("best.names") > 0).select("product_title", F.col("best.text").alias("text"))


def _variants_by_lookup(variants: DataFrame, fragments: DataFrame | None = None) -> DataFrame:
    """The best variant of each lookup and kind of gap: longest title first.

    ``fragments`` lists titles with early wildcards by fragment; others are listed by their head.

    Variants with the same lookup differ, for a given line, only in whether
    SKU and name are known. One of each sort is enough, so a SKU or title held
    by very many variants adds at most four rows. Title and cost settle ties,
    so the winner does not depend on row order.
    """
    title, sku, name = F.col("product_title"), F.col("sku"), F.col("lineitem_name")
    lookups = F.concat(
        _lookup(BOTH, sku, name),
        _lookup(SKU, sku),
        _lookup(NAME, name),
        _lookup(TITLE, F.when(~_by_fragment(title), _title_head(title))),
    )
    rank = F.struct(F.length(title).alias("title_length"), "product_title", "cost_per_item")
    about = [
        _title_pattern(title).alias("title_pattern"),
        sku.isNull().alias("no_sku"),
        name.isNull().alias("no_name"),
        rank.alias("rank"),
    ]
    listed = variants.select(F.inline(lookups), *about)
    if fragments is not None:
        early = variants.filter(_by_fragment(title)).hint("merge").join(fragments, "product_title")
        listed = listed.unionByName(
            early.select(F.lit(FRAGMENT).alias("kind"), "text", F.lit("").alias("text2"), *about)
        )
    pattern = F.when(F.col("kind").isin(TITLE, FRAGMENT), F.col("title_pattern")).alias("pattern")
    return listed.groupBy(*_LOOKUP, pattern, "no_sku", "no_name").agg(F.max("rank").alias("rank"))


def _lines_by_fragment(keys: DataFrame, titles: DataFrame, fragments: DataFrame) -> DataFrame:
    """Each line key once per listed fragment that its name contains."""
    listed = fragments.select("text").distinct()
    found = _name_fragments(keys, titles).hint("merge").join(listed, "text", "left_semi")
    probes = keys.filter(F.col("lineitem_name").isNotNull()).hint("merge").join(found, "lineitem_name")
    return probes.select(*LINE, F.lit(FRAGMENT).alias("kind"), "text", F.lit("").alias("text2"))


def _lines_by_lookup(keys: DataFrame, variants: DataFrame) -> DataFrame:
    """Each line key once per lookup, with a prefix for every title length."""
    head_lengths = (
        variants.filter(F.col("product_title").isNotNull() & ~_by_fragment(F.col("product_title")))
        .agg(F.collect_set(F.length(_title_head(F.col("product_title")))).alias("lengths"))
        .select("lengths")
        .scalar()
    )
    sku, name = F.col("sku"), F.col("lineitem_name")
    exact = keys.select(
        *LINE, F.inline(F.concat(_lookup(BOTH, sku, name), _lookup(SKU, sku), _lookup(NAME, name)))
    )
    fitting = F.array_intersect(F.sequence(F.lit(0), F.length(name)), head_lengths)
    prefixes = (
        keys.filter(name.isNotNull())
        .select(*LINE, F.explode(fitting).alias("length"))
        .select(
            *LINE,
            F.lit(TITLE).alias("kind"),
            name.substr(F.lit(1), F.col("length")).alias("text"),
            F.lit("").alias("text2"),
        )
    )
    return exact.unionByName(prefixes)


def _candidates(keys: DataFrame, variants: DataFrame) -> DataFrame:
    """Line keys beside the variants that share a lookup; patterns are not checked yet."""
    titles = _early_wildcards(variants)
    if titles.isEmpty():
        lookups, listed = _lines_by_lookup(keys, variants), _variants_by_lookup(variants)
    else:
        keys, titles = checkpoint(keys), checkpoint(titles)
        fragments = checkpoint(_rarest_fragments(keys, titles))
        lookups = _lines_by_lookup(keys, variants).unionByName(_lines_by_fragment(keys, titles, fragments))
        listed = _variants_by_lookup(variants, fragments)
    # Sizes are not estimated through an explode, so neither side may be broadcast.
    return lookups.hint("merge").join(listed, _LOOKUP)


def line_matches(
    lines: DataFrame, variants: DataFrame, unknown_is_different: bool = False
) -> DataFrame:
    """What each distinct (sku, lineitem_name) matches in the catalog.

    ``in_catalog``: some variant has the SKU or a title the name starts with.
    ``product_title`` and ``cost_per_item``: those of the single best variant
    by SKU, exact name or title. Candidates rank by "same SKU" (true, then
    false, then unknown), then "same name" likewise, then the longest title.
    A line with a SKU thus prefers a variant with some other SKU to one
    without a SKU, whatever their names. With ``unknown_is_different`` an unknown
    SKU or name ranks like a different one: same SKU, then same name, then the
    longest title. Pairs without a match are left out.
    """
    keys = lines.select(*LINE).distinct()
    candidates = _candidates(keys, variants).filter(
        F.col("pattern").isNull() | F.rlike("lineitem_name", F.col("pattern"))
    )
    kind = F.col("kind")

    def equality(known_equal: Column, line_column: str, variant_missing: str) -> Column:
        # False when both sides are known, NULL when either is not. A variant
        # that is equal after all also enters by its own, higher lookup.
        known = F.col(line_column).isNotNull() & ~F.col(variant_missing)
        if unknown_is_different:
            return F.coalesce(known_equal, F.lit(False))
        return F.when(known_equal, True).when(known, False)

    rank = F.struct(
        equality(kind.isin(BOTH, SKU), "sku", "no_sku").alias("same_sku"),
        equality(kind.isin(BOTH, NAME), "lineitem_name", "no_name").alias("same_name"),
        "rank",
    )
    winners = candidates.groupBy(*LINE).agg(
        F.max(rank).alias("best"), F.bool_or(kind != NAME).alias("in_catalog")
    )
    return winners.select(
        *LINE,
        "in_catalog",
        F.col("best.rank.product_title").alias("product_title"),
        F.col("best.rank.cost_per_item").alias("cost_per_item"),
    )


def in_catalog(lines: DataFrame, matches: DataFrame) -> DataFrame:
    """Keep the rows whose (sku, lineitem_name) is in the current catalog.

    The result depends on the pair alone, so where a question sums lines per
    pair anyway, it should do so first: the join then moves far less.
    """
    return null_safe_join(lines, matches.filter("in_catalog"), LINE, "left_semi")


def with_best_variant(lines: DataFrame, matches: DataFrame, how: str = "left") -> DataFrame:
    """Add the best variant's title and cost."""
    best = matches.select(*LINE, "product_title", "cost_per_item")
    return null_safe_join(lines, best, LINE, how)


def with_match(lines: DataFrame, matches: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Lines with ``in_catalog``, the best variant's title and cost, and, given ``names``, their ``product`` number.

    Only names in the catalog have a number.
    """
    known = matches
    if names is not None:
        numbered = matches.filter("in_catalog").join(names, "lineitem_name", "left")
        others = matches.filter(~F.col("in_catalog"))
        known = numbered.unionByName(others, allowMissingColumns=True)
    found = null_safe_join(lines, known, LINE, "left")
    return found.withColumn("in_catalog", F.coalesce("in_catalog", F.lit(False)))
