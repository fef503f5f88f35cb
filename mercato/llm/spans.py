"""Where patterns occur in a text, with built-in functions only.

Positions are code points, ends exclusive. A pattern's matches are leftmost and
do not overlap. ``split`` gives the text between the matches and
``regexp_extract_all`` the matches, both by the same search, so running lengths
give the positions.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Running sums copy what they have, so they work in blocks of this many.
BLOCK = 512


@dataclass(frozen=True)
class Rule:
    """A kind of span. ``hint`` is a cheap pattern that every matching text contains.

    ``keep`` tells from (match, group) whether a match counts; ``group`` is the
    group it looks at. ``whole`` is a pattern that matches where ``pattern`` does, and to the
    end of what ``pattern`` finds the start of.
    """

    kind: str
    pattern: str
    hint: str
    keep: Callable[[Column, Column], Column] | None = None
    group: int = 0
    version: int = 1
    whole: str | None = None


def _running(values: Column) -> Column:
    """Zero, then the running sums."""
    return F.aggregate(
        values,
        F.array(F.lit(0)),
        lambda sums, v: F.concat(sums, F.array(F.element_at(sums, -1) + v)),
    )


def hinted(text: Column, rules: Sequence[Rule]) -> Column:
    """Whether the text may contain a match of any rule."""
    flags = [text.rlike(r.hint) for r in rules]
    any_of = flags[0]
    for flag in flags[1:]:
        any_of = any_of | flag
    return any_of


def _block_sums(sizes: Column) -> Callable[[Column], Column]:
    return lambda block: _running(F.slice(sizes, block * BLOCK + 1, F.lit(BLOCK)))


def _hit(rule: Rule) -> Callable[[Column, Column], Column]:
    def hit(end: Column, both: Column) -> Column:
        value = both["value"]
        kept = rule.keep(value, both["group"]) if rule.keep else F.lit(True)
        return F.struct(
            (end - F.length(value)).alias("start"),
            end.alias("end"),
            value.alias("value"),
            F.coalesce(kept, F.lit(False)).alias("kept"),
        )

    return hit


def _span(number: int) -> Callable[[Column], Column]:
    return lambda hit: F.struct(
        F.lit(number).alias("rule"),
        hit["start"].alias("start"),
        hit["end"].alias("end"),
        hit["value"].alias("value"),
    )


def with_matches(
    df: DataFrame, text: str, rules: Sequence[Rule], wanted: Column | None = None
) -> DataFrame:
    """Add for each rule ``__parts<i>`` and ``__hits<i>``.

    ``__hits`` is an array of (start, end, value, kept) and ``__parts`` the text before, between and
    after them. ``wanted`` is an array of kinds; other rules find nothing. Steps are
    separate selects so that no search runs twice.
    """
    of = F.col(f"`{text}`")
    none = F.array().cast("array<string>")
    strings = {}
    for i, rule in enumerate(rules):
        use = of.rlike(rule.hint)
        if wanted is not None:
            use = use & F.array_contains(wanted, rule.kind)
        strings[f"__parts{i}"] = F.when(use, F.split(of, rule.pattern, -1)).otherwise(F.array(of))
        for name, group in ((f"__all{i}", 0), (f"__group{i}", rule.group)):
            if name.startswith("__all") or group:
                strings[name] = F.when(
                    use, F.regexp_extract_all(of, F.lit(rule.pattern), F.lit(group))
                ).otherwise(none)
    df = df.withColumns(strings)
    df = df.withColumns(
        {
            f"__sizes{i}": F.zip_with(
                F.slice(f"__parts{i}", 1, F.size(f"__all{i}")),
                f"__all{i}",
                lambda part, hit: F.length(part) + F.length(hit),
            )
            for i in range(len(rules))
        }
    )
    df = df.withColumns(
        {
            f"__inner{i}": F.transform(
                F.sequence(F.lit(0), F.floor(F.size(f"__sizes{i}") / BLOCK).cast("int")),
                _block_sums(F.col(f"__sizes{i}")),
            )
            for i in range(len(rules))
        }
    )
    df = df.withColumns(
        {
            f"__outer{i}": _running(F.transform(f"__inner{i}", lambda sums: F.element_at(sums, -1)))
            for i in range(len(rules))
        }
    )
    df = df.withColumns(
        {
            f"__ends{i}": F.flatten(
                F.zip_with(
                    f"__inner{i}",
                    F.slice(f"__outer{i}", 1, F.size(f"__inner{i}")),
                    lambda sums, base: F.transform(F.slice(sums, 2, BLOCK), lambda s: s + base),
                )
            )
            for i in range(len(rules))
        }
    )
    hits = {}
    for i, rule in enumerate(rules):
        group = f"__group{i}" if rule.group else f"__all{i}"
        pairs = F.zip_with(
            f"__all{i}", group, lambda v, g: F.struct(v.alias("value"), g.alias("group"))
        )
        hits[f"__hits{i}"] = F.zip_with(f"__ends{i}", pairs, _hit(rule))
    used = [f"__{n}{i}" for n in ("all", "group", "sizes", "inner", "outer", "ends") for i in range(len(rules))]
    return df.withColumns(hits).drop(*used)


def all_spans(rules: Sequence[Rule]) -> Column:
    """Kept hits of every rule as one array of (rule, start, end, value)."""
    return F.flatten(
        F.array(
            *[
                F.transform(F.filter(f"__hits{i}", lambda h: h["kept"]), _span(i))
                for i in range(len(rules))
            ]
        )
    )


def replaced(body: Column, marks: Column) -> Column:
    """``body`` with a mark in place of spans (start, end, mark), sorted by start.

    Where spans overlap, the first mark stands for all.
    """
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def put(state, s):
        fresh = F.concat(
            state["out"], F.array(F.substr(body, state["at"] + 1, s["start"] - state["at"]), s["mark"])
        )
        return F.struct(
            F.greatest(state["at"], s["end"]).alias("at"),
            F.when(s["start"] >= state["at"], fresh).otherwise(state["out"]).alias("out"),
        )

    def end(state):
        rest = F.substr(body, state["at"] + 1, F.length(body))
        return F.concat_ws("", F.concat(state["out"], F.array(rest)))

    return F.aggregate(marks, start, put, end)


def digest_text(spans: Column, kinds: Sequence[str], by_start: bool) -> Column:
    """``kind:start:end`` of spans (rule, start, end), ordered and comma-joined."""
    first, second = ("start", "rule") if by_start else ("rule", "start")
    order = F.array_sort(
        F.transform(
            spans,
            lambda s: F.struct(s[first].alias("a"), s[second].alias("b"), s["end"].alias("end")),
        )
    )
    names = F.array(*[F.lit(k) for k in kinds])

    def one(s):
        rule, start = (s["b"], s["a"]) if by_start else (s["a"], s["b"])
        return F.concat_ws(":", F.get(names, rule), start.cast("string"), s["end"].cast("string"))

    return F.concat_ws(",", F.transform(order, one))
