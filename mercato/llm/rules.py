"""Quality rules as a ledger of failure bits.

Every rule is evaluated once. The ledger keeps a text's measurements and one
bit for each failed rule; a policy is a version with a mask of bits that
reject. Other policies, and what a policy would keep without one of its rules, are then bit
operations on the ledger, without reading a text again.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import per_text, utf8, without

SYMBOLS = b"#*$%&|<>"
BLANKS = b" \t\n\r\x0b\f"
CAPITALS = bytes(range(65, 91))
LETTERS = CAPITALS + bytes(range(97, 123))
#: First bytes of characters of two bytes or more, and of three or more, in UTF-8.
NOT_ASCII = bytes(range(0xC0, 0x100))
WIDE = bytes(range(0xE0, 0x100))
WINDOW = 5
MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_capitals",
    "n_letters",
    "n_wide",
)


@dataclass(frozen=True)
class Rule:
    """A rule by name and the SQL condition on measurements under which a text fails."""

    name: str
    fails: str


#: A rule's bit is its place. Places never change; new rules go to the end.
RULES = (
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", "10 * n_symbols > 2 * n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    # Letters of any script count, so an acronym in another one is no shouting.
    Rule("capitals", "100 * n_capitals > 40 * n_letters"),
    Rule("short_words", "word_chars < 2 * n_words"),
    # Scripts that are written without blanks have no words to measure.
    Rule("long_words", "word_chars > 40 * n_words and 2 * n_wide <= word_chars"),
)
BASE = ("few_words", "repeated_windows")


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject."""

    version: str
    rejects: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << i for i, r in enumerate(RULES) if r.name in self.rejects)


POLICIES = {
    p.version: p
    for p in (
        Policy("base", BASE),
        Policy("v1", tuple(r.name for r in RULES)),
    )
}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in windows of ``window`` words found twice or more, by exact comparison."""
    count = len(words) - window + 1
    if count < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    kinds = len(numbers)
    if kinds == len(words):
        return 0
    keys = ids[:count]
    size = kinds
    for k in range(1, window):
        if size * kinds >= 1 << 62:  # number the distinct prefixes afresh, so keys stay exact
            _, keys = np.unique(keys, return_inverse=True)
            size = int(keys.max()) + 1
        keys = keys * kinds + ids[k : k + count]
        size *= kinds
    _, which, found = np.unique(keys, return_inverse=True, return_counts=True)
    again = found[which] >= 2
    inside = np.zeros(len(words), bool)
    for k in range(window):
        inside[k : k + count] |= again
    return int(inside.sum())


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of ``MEASURES``.

    Letters are those of ASCII and all characters beyond it; wide characters lie from U+0800 on, as do those
    of the scripts without blanks.
    """
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    inner = text.translate(None, BLANKS)
    return (
        len(words),
        len(inner.decode("utf-8", "replace")),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        len(text) - len(text.translate(None, CAPITALS)),
        len(text) - len(text.translate(None, LETTERS + NOT_ASCII)),
        len(text) - len(text.translate(None, WIDE)),
    )


def failure_bits(rules: Sequence[Rule] = RULES) -> Column:
    """The bits of the rules that fail, from measurement columns, as bigint."""
    bits = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(0).cast("bigint"))
    return bits


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed``, the bits of failed rules.

    Null texts measure like empty ones: zero of everything, so they have too few words.
    Rows are neither dropped nor merged. Input columns named like a result
    column are replaced.
    """
    fields = {m: pa.int64() for m in MEASURES}
    ddl = "struct<" + ", ".join(f"{m}: bigint" for m in MEASURES) + ">"
    run = per_text(lambda: measure, fields, ddl)
    source = [c for c in docs.columns if c.lower() in MEASURES and c.lower() == text.lower()]
    if source:
        raise ValueError(f"the text column may not be named {source[0]}")
    kept = without(docs.withColumn("__measures", run(utf8(text))), *MEASURES, "failed")
    wide = kept.select("*", *[F.col(f"__measures.{m}").alias(m) for m in MEASURES]).drop("__measures")
    return wide.withColumn("failed", failure_bits())


def kept_by(policy: Policy) -> Column:
    return F.col("failed").bitwiseAND(F.lit(policy.mask).cast("bigint")) == 0


def apply_policy(entries: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """Ledger rows with ``kept`` by the policy."""
    return without(entries, "kept").withColumn("kept", kept_by(policy))


def ablations(entries: DataFrame, policy: Policy = POLICIES["v1"]) -> DataFrame:
    """For each rule of the policy: rows that fail it, that fail it alone, and rows kept without it.

    One aggregation by failure bits, of which there are few, and then bit
    operations. An empty ledger gives zero counts.
    """
    masks = entries.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(
        F.count("*").alias("n")
    )
    chosen = [(1 << i, r.name) for i, r in enumerate(RULES) if r.name in policy.rejects]

    def rows(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("bigint")

    sums = masks.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("rule"),
                    rows(F.col("bits").bitwiseAND(F.lit(bit)) != 0).alias("failing"),
                    rows(F.col("bits") == bit).alias("failing_alone"),
                    rows(F.col("bits").bitwiseAND(F.lit(policy.mask & ~bit)) == 0).alias("kept_without"),
                )
                for bit, name in chosen
            ]
        ).alias("all")
    )
    return sums.select(F.inline("all"))


def report(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measurements, the base verdict and the policy's verdict, by row."""
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    judged = apply_policy(ledger(rows))
    return judged.select(
        "doc_id",
        *MEASURES[:5],
        (~kept_by(POLICIES["base"])).alias("base_failed"),
        "kept",
        "failed",
    )


def passing(docs: DataFrame, text: str = "text", policy: Policy = POLICIES["v1"]) -> DataFrame:
    """The rows of ``docs`` that the policy keeps, with its columns."""
    marked = docs.select("*", *[F.col(f"`{text}`").alias("__text")])
    names = [c for c in docs.columns]
    packed = marked.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("__row"), "__text")
    good = apply_policy(ledger(packed, "__text"), policy).filter("kept")
    return good.select(*[F.col(f"__row.`{c}`").alias(c) for c in names])
