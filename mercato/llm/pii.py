"""Personal data, and terms that give it away.

Entities are found by pattern. Other terms of a text may reveal an entity even when it
is masked: how much is estimated from co-occurrence over the whole corpus. With
``n`` rows, an entity in ``c_e`` of them carries ``log2(n / c_e)`` bits. A term's
pointwise mutual information with it, ``log2(joint * n / (c_e * c_t))`` with ``joint / c_t``
smoothed, is the part of these bits that the term discloses. Terms that disclose more than a share of them
are generalised, and removed if they disclose nearly all.

Personal values rarely recur, so each also counts as its group, which does: the
mail domain, the network, the issuer, the area. A term that gives away the group
narrows the value down. The kind is no group, as the mark names it.

A term counts wherever it stands in a text with the entity, and is marked at each
place there. A text without the entity holds nothing that the term could give away, so
it stays.

Counts are of rows, so copies of a text count. Built-in functions only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mercato.llm.common import whole_text, without
from mercato.llm.secrets import blob_id
from mercato.llm.spans import Rule, all_spans, digest_text, hinted, replaced, with_matches
from mercato.operators.joins import spread_join
from mercato.session import checkpoint


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _byte_parts(value: Column, _: Column) -> Column:
    part = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return value.rlike(rf"^{part}(?:\.{part}){{3}}$")


def _card(value: Column, _: Column) -> Column:
    return F.length(_digits(value)).between(16, 19) & F.call_function("luhn_check", _digits(value))


def _phone(value: Column, _: Column) -> Column:
    return F.length(_digits(value)).between(8, 15)


LOCAL = "A-Za-z0-9._%+-"
#: Kinds in the order in which spans are listed. A search starts only where a run of the
#: first class starts, or where the last match ended, and never gives characters back;
#: this finds the same matches in linear time and without recursion.
RULES = (
    Rule(
        "email",
        rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "@[A-Za-z0-9-]",
    ),
    Rule(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]",
        _byte_parts,
    ),
    Rule("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9](?:[\x20-]?[0-9]){15}", _card),
    Rule("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9]", _phone),
)
KINDS = (*(r.kind for r in RULES), "term")
#: Runs of letters, with their accents. Chinese characters, which no blanks separate, go in pairs.
TERM = Rule("term", r"\p{IsHan}{1,2}+|[\p{L}&&[^\p{IsHan}]][[\p{L}\p{M}]&&[^\p{IsHan}]]*+", r"\p{L}")
#: Texts that a task searches for entities, about.
TEXTS_PER_TASK = 256
NO_SPANS = "array<struct<rule: int, start: int, end: int>>"


def _names(number: int) -> Callable[[Column], Column]:
    """The entities of a kept hit: its value, and the group it belongs to."""
    kind = KINDS[number]

    def of(hit: Column) -> Column:
        value = F.lower(hit["value"])
        group = {
            "email": F.substring_index(value, "@", -1),
            "ip": F.regexp_replace(F.substring_index(value, ".", 2), r"\b0+(?=[0-9])", ""),
            "card": F.left(_digits(value), F.lit(6)),
            "phone": F.left(_digits(value), F.lit(4)),
        }[kind]
        return F.array(F.concat(F.lit(f"{kind}:"), value), F.concat(F.lit(f"{kind} group:"), group))

    return of


def _same_case(text: Column) -> Column:
    """Lower case; the form of a sigma, which depends on what follows, is dropped."""
    small = F.lower(text)
    return F.when(small.contains("ς"), F.translate(small, "ς", "σ")).otherwise(small)


def _plain() -> Column:
    """The text with figures for mail addresses, so places stay. Other entities hold no letters."""
    figures = F.transform("__hits0", lambda h: F.repeat(F.lit("0"), h["end"] - h["start"]))
    pieces = F.zip_with("__parts0", F.concat(figures, F.array(F.lit(""))), lambda part, hit: F.array(part, hit))
    return F.concat_ws("", F.flatten(pieces))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts with entities, one row each: ``blob``, ``rows`` that hold it, ``base`` spans,
    ``names`` of the entities and ``words`` (term, start, end). Texts are told apart by SHA-256."""
    possible = (
        docs.select(blob_id(text).alias("blob"), whole_text(text).alias("content"))
        .filter(hinted(F.col("content"), RULES))
        .groupBy("blob")
        .agg(F.first("content").alias("content"), F.count("*").alias("rows"))
    )
    possible = checkpoint(possible)
    # Few bytes to shuffle, but much work: dealt out by the number of texts. Stored, as Spark
    # would search before it deals out, and again after.
    dealt = checkpoint(possible.repartition(-(-possible.count() // TEXTS_PER_TASK) or 1))
    found = with_matches(dealt, "content", RULES)
    names = [
        F.flatten(F.transform(F.filter(f"__hits{i}", lambda h: h["kept"]), _names(i)))
        for i in range(len(RULES))
    ]
    base = F.transform(
        all_spans(RULES),
        lambda s: F.struct(s["rule"].alias("rule"), s["start"].cast("int").alias("start"), s["end"].cast("int").alias("end")),
    )
    found = found.select(
        "blob",
        "rows",
        base.alias("base"),
        F.array_distinct(F.flatten(F.array(*names))).alias("names"),
        _plain().alias("plain"),
    ).filter(F.size("base") > 0)
    words = F.transform(
        "__hits0",
        lambda h: F.struct(
            _same_case(h["value"]).alias("term"),
            h["start"].cast("int").alias("start"),
            h["end"].cast("int").alias("end"),
        ),
    )
    return with_matches(found, "plain", [TERM]).select("blob", "rows", "base", "names", words.alias("words"))


def term_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(code, n)``: in how many rows each term occurs, by the term's 64-bit hash."""
    email = RULES[0]
    content = whole_text(text)
    plain = F.when(content.rlike(email.hint), F.regexp_replace(content, email.pattern, "0")).otherwise(content)
    words = F.regexp_extract_all(_same_case(plain), F.lit(TERM.pattern), F.lit(0))
    each = docs.select(F.explode(F.array_distinct(words)).alias("word"))
    return each.groupBy(F.xxhash64("word").alias("code")).agg(F.count("*").alias("n"))


def disclosed(joint: Column, c_e: Column, c_t: Column, rows: int) -> Column:
    """The share of an entity's bits that a term discloses.

    How likely the entity is beside the term, ``joint / c_t``, is drawn to its likelihood anywhere by one row, so a
    pair that was seen once or twice counts, but for less than one that was seen often.
    """
    anywhere = c_e / F.lit(float(rows))
    beside = (joint + anywhere) / (c_t + 1)
    return F.log2(beside / anywhere) / -F.log2(anywhere)


def counted_terms(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """``blob, rows, term, c_t``: each term of each text once, with the rows that hold it anywhere."""
    terms = found.select("blob", "rows", F.explode(F.array_distinct("words.term")).alias("term"))
    coded = terms.withColumn("code", F.xxhash64("term")).withColumn("spread", F.xxhash64("code"))
    # A second key asks for a fresh shuffle, so a frequent term can be split.
    counts = term_counts(docs, text).withColumnRenamed("n", "c_t").withColumn("spread", F.xxhash64("code"))
    return coded.join(counts, ["code", "spread"]).drop("code", "spread")


def disclosing(found: DataFrame, docs: DataFrame, text: str, share: float) -> DataFrame:
    """``blob, term, disclosed``: the terms of each text that disclose at least ``share`` of the bits of one of its entities.

    All terms of a text lie beside an entity that no other text holds, so only their own counts matter.
    Pairs with other entities are counted; a term that is too frequent to disclose an entity, even if it were
    always beside it, makes no pair.
    """
    total = docs.count()
    names = found.select("blob", "rows", F.explode("names").alias("entity"))
    counts = names.groupBy("entity").agg(F.count("*").alias("texts"), F.sum("rows").alias("c_e"))
    known = spread_join(names, counts.filter(F.col("c_e") < total), "entity")
    terms = checkpoint(counted_terms(found, docs, text))

    def most(c_e: Column) -> Column:
        return disclosed(c_e, c_e, F.col("c_t"), total)

    alone = known.filter("texts = 1").select("blob").distinct()
    # Copies are the only rows that hold such an entity.
    sole = terms.join(alone, "blob", "left_semi").filter(F.col("rows") < total)
    sole = sole.select("blob", "term", most(F.col("rows")).alias("disclosed"))
    recurring = known.filter("texts > 1").select("blob", "entity", "c_e")
    pairs = terms.hint("merge").join(recurring, "blob").filter(most(F.col("c_e")) >= share)
    joint = pairs.groupBy("entity", "term", "c_e", "c_t").agg(F.sum("rows").alias("joint"))
    beside = joint.select(
        "entity", "term", disclosed(F.col("joint"), F.col("c_e"), F.col("c_t"), total).alias("disclosed")
    )
    risky = beside.filter(F.col("disclosed") >= share)
    shared = pairs.select("blob", "entity", "term").join(risky, ["entity", "term"]).select("blob", "term", "disclosed")
    every = sole.filter(F.col("disclosed") >= share).unionByName(shared)
    return every.groupBy("blob", "term").agg(F.max("disclosed").alias("disclosed"))


def findings(docs: DataFrame, text: str = "text", share: float = 0.8) -> DataFrame:
    """Per distinct text with entities: ``blob, base, terms``.

    ``terms`` are spans (start, end, disclosed) of the terms that disclose at least ``share`` of the bits of an
    entity of the text, at every place in it. All other texts have nothing.
    """
    found = checkpoint(entities(docs, text))
    marked = checkpoint(disclosing(found, docs, text, share))
    spans = (
        found.join(marked.select("blob").distinct(), "blob", "left_semi")
        .select("blob", F.inline("words"))
        .join(marked, ["blob", "term"])
        .groupBy("blob")
        .agg(F.collect_list(F.struct("start", "end", "disclosed")).alias("terms"))
    )
    none = F.array().cast("array<struct<start: int, end: int, disclosed: double>>")
    return found.select("blob", "base").join(spans, "blob", "left").withColumn(
        "terms", F.coalesce("terms", none)
    )


def scan(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with ``base`` spans (rule number, start, end) and ``terms`` spans, see :func:`findings`.

    Null and empty texts have none. Rows are neither dropped nor merged; input columns named
    ``base`` or ``terms`` are replaced, unless one is the text.
    """
    per_text = checkpoint(findings(docs, text, **options))
    keyed = docs.withColumn("__blob", blob_id(text))
    taken = [c for c in ("base", "terms") if c != text.lower()]
    # A second key asks for a fresh shuffle, so a hot text can be split.
    joined = (
        without(keyed, *taken)
        .withColumn("__s", F.xxhash64("__blob"))
        .join(
            per_text.withColumnRenamed("blob", "__blob").withColumn("__s", F.xxhash64("__blob")),
            ["__blob", "__s"],
            "left",
        )
    )
    return joined.withColumns(
        {
            "base": F.coalesce("base", F.array().cast(NO_SPANS)),
            "terms": F.coalesce(
                "terms", F.array().cast("array<struct<start: int, end: int, disclosed: double>>")
            ),
        }
    ).drop("__blob", "__s")


def sanitise(docs: DataFrame, text: str = "text", removal: float = 0.95, **options) -> DataFrame:
    """``docs`` with entities replaced by their kind, as ``[EMAIL]``.

    Disclosing terms become ``[TERM]``, or nothing if they disclose ``removal`` of the bits or more. Where
    spans overlap, the first mark stands for all. Texts without findings stay as they are.
    """
    columns = docs.columns
    found = scan(docs.withColumn("__text", F.col(f"`{text}`")), "__text", **options)
    names = F.array(*[F.lit(f"[{r.kind.upper()}]") for r in RULES])
    marks = F.array_sort(
        F.concat(
            F.transform(
                "base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.get(names, s["rule"]).alias("mark"))
            ),
            F.transform(
                "terms",
                lambda s: F.struct(
                    s["start"].alias("start"),
                    s["end"].alias("end"),
                    F.when(s["disclosed"] >= removal, F.lit("")).otherwise(F.lit("[TERM]")).alias("mark"),
                ),
            ),
        )
    )
    body = F.col("__text")
    clean = found.withColumn("__marks", marks).withColumn(
        "__clean", F.when(F.size("__marks") > 0, replaced(body, F.col("__marks"))).otherwise(body)
    )
    return clean.select(*[(F.col("__clean").alias(c) if c == text else F.col(f"`{c}`")) for c in columns])


def report(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, by row."""
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    found = scan(rows, **options).drop("text")
    every = F.concat(
        "base",
        F.transform(
            "terms",
            lambda s: F.struct(F.lit(len(RULES)).alias("rule"), s["start"].alias("start"), s["end"].alias("end")),
        ),
    )
    return found.select(
        "doc_id",
        *[
            F.size(F.filter("base", _is_rule(i))).cast("bigint").alias(f"n_{r.kind}")
            for i, r in enumerate(RULES)
        ],
        F.sha2(digest_text(F.col("base"), KINDS, False).cast("binary"), 256).alias("base_sha256"),
        digest_text(every, KINDS, False).alias("spans"),
    )


def _is_rule(number: int):
    return lambda span: span["rule"] == number
