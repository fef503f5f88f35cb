"""Secret scans over a ledger of blobs.

A version of a path is addressed by the SHA-256 of its content. Each distinct
content is a blob and is scanned once for each version of a rule: a ledger says which
(blob, rule version) pairs were seen. Findings are stored by blob and joined
back to every path that ever held it. Built-in functions only.

Spans cover whole secrets: tokens of any length, and key blocks to their END line or, without one, over the
base64 text that follows. Redaction also takes a last short piece of such a key that nothing sets apart from prose.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mercato.llm.common import whole_text, without
from mercato.llm.spans import Rule, all_spans, digest_text, hinted, replaced, with_matches

HEADER = r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
#: A line break as such or written as an escape, or a blank.
BREAK = r"(?:\\[rn]|\s)"
#: The key after its header: to the END line or, without one, what looks like base64.
BODY = (
    r"(?:(?s:(?!-----(?:BEGIN|END)\x20).)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    r"|(?:\r?\n(?:Proc-Type|DEK-Info):[^\r\n]*+)*+"
    rf"(?:(?:{BREAK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:{BREAK}++[A-Za-z0-9+/]++={{0,2}}+(?![^\s\\\"'<]))?+"
    rf"|(?:\\[rn]|[\r\n])++[A-Za-z0-9+/]++={{0,2}}+(?![^\r\n\\\"']))?+)"
)
#: The same as far as it can be told without looking ahead.
BLANK = r"(?:\\[rn]|[\t\n\f\r\x20])"
KEY_BLOCK = HEADER + (
    r"(?:[^-]*+(?:-{1,4}[^-]++)*+-----END [A-Z ]{0,40}PRIVATE KEY-----"
    rf"|(?:{BLANK}*+[A-Za-z0-9+/]{{16,}}+={{0,2}}+)++(?:{BLANK}++[A-Za-z0-9+/]++={{1,2}}+)?+)?+"
)
KEYWORD = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]"
#: Kinds in the order in which spans are listed; the first three are always on.
RULES = (
    Rule(
        "assign",
        r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        KEYWORD,
        lambda _, value: F.length(value) >= 12,
        group=2,
    ),
    Rule("access", r"AKIA[A-Z0-9]{14,}", r"AKIA[A-Z0-9]{14}"),
    Rule("hex", r"[0-9a-f]{16,}", r"[0-9a-f]{16}"),
    Rule("key_block", KEY_BLOCK, r"-----BEGIN ", version=2, whole=HEADER + BODY),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}", version=2),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-", version=2),
)
BASE = ("assign", "access", "hex")
FINDINGS = "blob binary, rule string, version int, start int, end int"
SEEN = "blob binary, rules array<string>, batch string"


def blob_id(text: str):
    """The content address: SHA-256 of the UTF-8 text, empty for null."""
    return F.unhex(F.sha2(whole_text(text).cast("binary"), 256))


def marks(rules: Sequence[Rule]) -> dict[str, Rule]:
    return {f"{r.kind}@{r.version}": r for r in rules}


def scan_unseen(
    versions: DataFrame, text: str, rules: Sequence[Rule] = RULES, seen: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(findings, newly seen)`` of blobs and rule versions that ``seen`` lacks.

    ``versions`` has a row for each version of a path. Findings have (blob, rule,
    version, start, end), newly seen (blob, rules). Null texts are the empty blob;
    equal contents are scanned once, however many rows hold them. Only texts in which a rule may find
    something are shuffled; of the others their address is enough.
    """
    every = F.array(*[F.lit(m) for m in marks(rules)])
    content = whole_text(text)
    blobs = (
        versions.select(blob_id(text).alias("blob"), F.when(hinted(content, rules), content).alias("content"))
        .groupBy("blob")
        .agg(F.first("content").alias("content"))
    )
    if seen is None:
        blobs = blobs.withColumn("todo", every)
    else:
        done = seen.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        none = F.array().cast("array<string>")
        blobs = (
            blobs.join(done, "blob", "left")
            .withColumn("todo", F.array_except(every, F.coalesce("done", none)))
            .filter(F.size("todo") > 0)
            .drop("done")
        )
    kinds = F.transform(F.col("todo"), lambda m: F.element_at(F.split(m, "@"), 1))
    possible = blobs.filter(F.col("content").isNotNull()).withColumn("kinds", kinds)
    found = with_matches(possible, "content", rules, F.col("kinds")).select(
        "blob", F.inline(all_spans(rules))
    )
    names = F.array(*[F.lit(r.kind) for r in rules])
    numbers = F.array(*[F.lit(r.version) for r in rules])
    findings = found.select(
        "blob",
        F.get(names, F.col("rule")).alias("rule"),
        F.get(numbers, F.col("rule")).alias("version"),
        F.col("start").cast("int").alias("start"),
        F.col("end").cast("int").alias("end"),
    )
    return findings, blobs.select("blob", F.col("todo").alias("rules"))


class Ledger:
    """The stored ledger: what was seen, and what was found, by blob.

    A scan writes its findings first and then what it has seen, each as one
    Spark write. Findings count once their batch is among the seen, so a scan
    that dies in between is simply scanned again. Two scans at once may both scan a blob; what both
    find counts once.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _table(self, name: str, ddl: str) -> DataFrame:
        try:
            return self.spark.read.schema(ddl).parquet(f"{self.folder}/{name}")
        except AnalysisException as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
            return self.spark.createDataFrame([], ddl)

    def seen(self) -> DataFrame:
        return self._table("seen", SEEN)

    def findings(self) -> DataFrame:
        batches = self.seen().select("batch").distinct()
        found = self._table("findings", f"{FINDINGS}, batch string")
        return found.join(batches, "batch", "left_semi").drop("batch").distinct()

    def scan(self, versions: DataFrame, text: str, rules: Sequence[Rule] = RULES) -> None:
        batch = uuid.uuid4().hex
        findings, new = scan_unseen(versions, text, rules, self.seen())
        stamped = findings.withColumn("batch", F.lit(batch))
        stamped.write.mode("append").parquet(f"{self.folder}/findings")
        new.withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.folder}/seen")


def by_path(
    versions: DataFrame, text: str, findings: DataFrame, rules: Sequence[Rule] = RULES
) -> DataFrame:
    """Every row of ``versions`` with its findings, as ``spans`` (rule number, start, end).

    Rows without findings get an empty array. A ``spans`` column of the input is
    replaced. Rows are neither dropped nor merged.
    """
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    number = (F.array_position(kinds, F.col("rule")) - 1).cast("int")
    spans = findings.groupBy("blob").agg(
        F.collect_list(F.struct(number.alias("rule"), "start", "end")).alias("spans")
    )
    keyed = without(versions, "spans", "__blob").withColumn("__blob", blob_id(text))
    # A second key asks for a fresh shuffle, so a hot blob can be split.
    joined = keyed.withColumn("__s", F.xxhash64("__blob")).join(
        spans.select(F.col("blob").alias("__blob"), "spans", F.xxhash64("blob").alias("__s")),
        ["__blob", "__s"],
        "left",
    )
    none = F.array().cast("array<struct<rule: int, start: int, end: int>>")
    return joined.withColumn("spans", F.coalesce("spans", none)).drop("__blob", "__s")


def scan(
    versions: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, ledger: Ledger | None = None
) -> DataFrame:
    """``versions`` with their ``spans``, see :func:`by_path`.

    With a ledger only what it has not seen is scanned, and it keeps that; findings of other rule
    versions in it do not count. Without one it is a first scan.
    """
    if ledger is None:
        findings, _ = scan_unseen(versions, text, rules)
    else:
        ledger.scan(versions, text, rules)
        asked = F.concat_ws("@", "rule", F.col("version").cast("string")).isin(list(marks(rules)))
        findings = ledger.findings().filter(asked)
    return by_path(versions, text, findings, rules)


def redact(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every found secret replaced by ``mark``; texts without one stay as they are.

    A secret goes to its end, also beyond its span. Secrets that overlap go together.
    """
    columns = docs.columns
    found = scan(docs, text, rules)
    # Only texts with findings are searched again; another text stays null here.
    df = found.withColumn("__text", F.when(F.size("spans") > 0, F.col(f"`{text}`")))
    spans = [F.col("spans")]
    wholes = [replace(r, pattern=r.whole, whole=None) for r in rules if r.whole]
    if wholes:
        df = with_matches(df, "__text", wholes)
        spans.append(all_spans(wholes))
    marks = [
        F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(mark).alias("mark")))
        for s in spans
    ]
    df = df.withColumn("__marks", F.array_sort(F.concat(*marks)))
    clean = F.when(F.col("__text").isNotNull(), replaced(F.col("__text"), F.col("__marks")))
    df = df.withColumn(text, F.coalesce(clean, F.col(f"`{text}`")))
    return df.select(*[F.col(f"`{c}`") for c in columns])


def report(docs: DataFrame, id: str = "doc_id", text: str = "text", ledger: Ledger | None = None) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, by row."""
    kinds = [r.kind for r in RULES]
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = scan(rows, ledger=ledger)

    def of(kind):
        return F.filter("spans", lambda s: s["rule"] == kinds.index(kind))

    base = F.filter("spans", lambda s: s["rule"] < len(BASE))
    return found.select(
        "doc_id",
        *[F.size(of(k)).cast("bigint").alias(f"n_{k}") for k in BASE],
        F.sha2(digest_text(base, kinds, True).cast("binary"), 256).alias("base_sha256"),
        digest_text(F.col("spans"), kinds, True).alias("spans"),
    )
