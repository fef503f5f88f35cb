"""URL filters by lists that change over time.

Lists come as dated events that add or remove an entry. Events become intervals
in which an entry is on a list, and an as-of join finds for every capture the
entries that were active when it was fetched. An entry is a domain, which
covers its subdomains, or a domain with a path, which covers what lies below. So a URL looks
up the domain's suffixes and the path's prefixes, by equality. Lookups are reduced to
distinct (key, day) before they meet the intervals, so a hot host costs one row a day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mercato.llm.common import without

#: Scheme, user and port are not part of a host.
HOST = r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
PATH = r"^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The host in lower case, empty if the URL has none."""
    return F.rtrim(F.regexp_extract(F.lower(url), HOST, 1), F.lit("."))


def segments_of(url: Column) -> Column:
    """The path's segments in lower case, without empty ones."""
    return F.filter(F.split(F.regexp_extract(F.lower(url), PATH, 1), "/"), lambda s: s != "")


def intervals(events: DataFrame) -> DataFrame:
    """``(list, entry, since, until)`` from ``(list, entry, action, day)``.

    ``action`` is ``add`` or ``remove``; an entry is on the list from ``since`` until before ``until``
    (null: still). Of several events on a day an add wins. Repeated adds and removes
    change nothing. Events with a null or another action are ignored. An entry's
    events are first reduced to one a day, so its window is bounded by days.
    """
    entry = F.regexp_replace(F.lower("entry"), r"/+$", "")
    daily = (
        events.filter(F.col("action").isin("add", "remove"))
        .select("list", entry.alias("entry"), "day", (F.col("action") == "add").alias("on"))
        .dropna()
        .groupBy("list", "entry", "day")
        .agg(F.max("on").alias("on"))
    )
    order = Window.partitionBy("list", "entry").orderBy("day")
    changes = daily.withColumn("was", F.lag("on", 1, False).over(order)).filter(F.col("on") != F.col("was"))
    spans = changes.withColumn("until", F.lead("day").over(order)).filter("on")
    return spans.select("list", "entry", F.col("day").alias("since"), "until")


def keys_of(url: Column, labels: int, segments: int) -> Column:
    """What a URL looks up: suffixes of up to ``labels`` labels, and the host with up to ``segments``
    path segments, after each suffix that ends the host."""
    parts = F.filter(F.split(host_of(url), r"\."), lambda p: p != "")
    count = F.size(parts)
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(count, F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, count - n + 1, n), "."),
    )
    path = segments_of(url)
    prefixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(path), F.lit(segments))),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(path, F.lit(1), n), "/")),
    )
    none = F.array().cast("array<string>")
    domains = F.when(F.least(count, F.lit(labels)) > 0, suffixes).otherwise(none)
    below = F.when(F.least(F.size(path), F.lit(segments)) > 0, prefixes).otherwise(none)
    paths = F.concat(F.array(F.lit("")), below)
    return F.coalesce(
        F.flatten(F.transform(domains, lambda d: F.transform(paths, lambda p: F.concat(d, p)))), none
    )


def filtered(
    captures: DataFrame,
    events: DataFrame,
    allow: tuple[str, ...] = ("allow",),
    url: str = "url",
    day: str = "fetched",
) -> DataFrame:
    """``captures`` with ``lists`` and ``blocked``.

    ``lists`` are the names of lists with an entry active on the capture's day, in order.
    A capture is blocked if any is active and none of them is an ``allow`` list. Captures
    without a host or a day are on no list. Rows are neither dropped nor merged; input columns
    named like a result are replaced.
    """
    spans = intervals(events)
    depth = spans.agg(
        F.max(F.size(F.split(F.split_part("entry", F.lit("/"), F.lit(1)), r"\."))).alias("labels"),
        F.max(F.size(F.split("entry", "/")) - 1).alias("segments"),
    ).first()
    pair = captures.select(F.col(f"`{url}`").alias("u"), F.col(f"`{day}`").alias("d")).dropna().distinct()
    lookups = pair.select(
        "u", "d", F.explode(keys_of(F.col("u"), depth["labels"] or 0, depth["segments"] or 0)).alias("key")
    )
    asked = lookups.select("key", "d").distinct()
    active = (
        asked.join(spans.withColumnRenamed("entry", "key"), "key")
        .filter((F.col("d") >= F.col("since")) & (F.col("until").isNull() | (F.col("d") < F.col("until"))))
        .groupBy("key", "d")
        .agg(F.collect_set("list").alias("found"))
    )
    by_url = lookups.join(active, ["key", "d"]).select("u", "d", F.explode("found").alias("list"))
    named = by_url.groupBy("u", "d").agg(F.array_sort(F.collect_set("list")).alias("lists"))
    kept = without(captures, "lists", "blocked")
    # A further key asks for a fresh shuffle, so a URL that is captured very often can be split.
    same = (F.col(f"`{url}`") == F.col("u")) & (F.col(f"`{day}`") == F.col("d"))
    spread = F.xxhash64(F.col(f"`{url}`"), F.col(f"`{day}`")) == F.col("__spread")
    joined = kept.join(named.withColumn("__spread", F.xxhash64("u", "d")), same & spread, "left").drop("u", "d", "__spread")
    found = joined.withColumn("lists", F.coalesce("lists", F.array().cast("array<string>")))
    allowed = F.arrays_overlap("lists", F.array(*[F.lit(a) for a in allow]))
    return found.withColumn("blocked", (F.size("lists") > 0) & ~allowed)


def _number(text: Column) -> Column:
    """A number below 2^24 from the text's MD5, the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


def sample_captures(pages: DataFrame) -> DataFrame:
    """``pages`` with a fetch day of 2024 from the URL's hash, as the tables have none."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), _number(F.col("url")) % 366)
    return pages.select("page_id", "url", day.alias("fetched"))


def sample_events(pages: DataFrame) -> DataFrame:
    """A list history over the hosts of ``pages``, derived from their hashes.

    A third of the hosts is added to ``spam``, removed later and, of these, half is added again; a fifth has its
    first path segment on ``ads``; a seventh is on ``allow``; a ninth of the registered domains is on ``malware``.
    """
    first = F.get(segments_of(F.col("url")), F.lit(0))
    hosts = pages.select(host_of(F.col("url")).alias("host"), first.alias("segment")).filter(F.col("host") != "")
    one = hosts.select("host").distinct().withColumn("x", _number(F.col("host")))
    below = (
        hosts.dropna()
        .select(F.concat("host", F.lit("/"), "segment").alias("entry"))
        .distinct()
        .withColumn("x", _number(F.col("entry")))
    )
    domains = (
        hosts.select(F.substring_index("host", ".", -2).alias("entry"))
        .distinct()
        .withColumn("x", _number(F.col("entry")))
    )

    def events(df: DataFrame, name: str, entry: str, action: str, when: Column, offset: Column) -> DataFrame:
        day = F.date_add(F.lit("2024-01-01").cast("date"), offset.cast("int"))
        return df.filter(when).select(F.lit(name).alias("list"), F.col(entry).alias("entry"), F.lit(action).alias("action"), day.alias("day"))

    x = F.col("x")
    parts = [
        events(one, "spam", "host", "add", x % 3 == 0, x % 200),
        events(one, "spam", "host", "remove", x % 3 == 0, F.lit(200) + x % 100),
        events(one, "spam", "host", "add", x % 6 == 0, F.lit(330)),
        events(below, "ads", "entry", "add", x % 5 == 0, x % 300),
        events(one, "allow", "host", "add", x % 7 == 0, x % 250),
        events(domains, "malware", "entry", "add", x % 9 == 0, F.lit(300) + x % 30),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
