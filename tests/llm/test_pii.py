import collections
import functools
import hashlib
import itertools
import math
import re

import regex
from pyspark.sql import functions as F

from mercato.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def digits(s):
    return re.sub("[^0-9]", "", s)


KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda v: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda v: all(int(p) <= 255 for p in v.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda v: 16 <= len(digits(v)) <= 19 and luhn(digits(v))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda v: 8 <= len(digits(v)) <= 15),
]


@functools.cache
def base_spans(text):
    return [
        (k, m.start(), m.end(), m[0])
        for k, (_, pattern, keep) in enumerate(KINDS)
        for m in re.finditer(pattern, text or "", re.ASCII)
        if keep(m[0])
    ]


TERM = regex.compile(r"(?V1)\p{Han}{1,2}+|[\p{L}--\p{Han}][[\p{L}\p{M}]--\p{Han}]*+")


def term_spans(text):
    plain = re.sub(KINDS[0][1], lambda m: "0" * len(m[0]), text or "", flags=re.ASCII)
    return [(m[0].lower(), m.start(), m.end()) for m in TERM.finditer(plain)]


def named(k, value):
    value, kind = value.lower(), KINDS[k][0]
    group = {
        0: lambda: value.rsplit("@", 1)[-1],
        1: lambda: ".".join(re.sub(r"^0+(?=[0-9])", "", p) for p in value.split(".")[:2]),
        2: lambda: digits(value)[:6],
        3: lambda: digits(value)[:4],
    }[k]()
    return {f"{kind}:{value}", f"{kind} group:{group}"}


def brute(texts, share=0.8):
    """All results by the definition, one text at a time."""
    n = len(texts)
    copies = collections.Counter(t or "" for t in texts)
    spans = {t: term_spans(t) for t in copies}
    terms = {t: {w for w, *_ in s} for t, s in spans.items()}
    held = {t: set().union(*[named(k, v) for k, _, _, v in base_spans(t)]) for t in copies}
    c_t = collections.Counter(w for t, c in copies.items() for w in terms[t] for _ in range(c))
    c_e = collections.Counter(e for t, c in copies.items() for e in held[t] for _ in range(c))
    joint = collections.Counter()
    for t, c in copies.items():
        for pair in itertools.product(held[t], terms[t]):
            joint[pair] += c

    def risky(e, w):
        if c_e[e] >= n:
            return False
        anywhere = c_e[e] / n
        return math.log2((joint[e, w] + anywhere) / (c_t[w] + 1) / anywhere) / -math.log2(anywhere) >= share

    names = [k for k, *_ in KINDS] + ["term"]
    rows = []
    for text in texts:
        t = text or ""
        base = sorted(s[:3] for s in base_spans(t))
        extra = sorted((len(KINDS), s, e) for w, s, e in spans[t] if any(risky(en, w) for en in held[t]))

        def listed(spans):
            return ",".join(f"{names[k]}:{s}:{e}" for k, s, e in spans)

        counts = [sum(s[0] == k for s in base) for k in range(4)]
        rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(base + extra)))
    return rows


SECRET = "Director Quixotry of Zanzibar, writes from jane@corp.example.com or +1 (555) 123-4567 daily"
TEXTS = [
    f"one {SECRET} once.",
    f"two é🙂 {SECRET} twice.",
    f"three {SECRET}\nthrice",
    f"three {SECRET}\nthrice",
    "a@b.c@d.e x_a@b.c_d@e.f .@-.- a@b @c.d 1@2.3.4 a@b..c",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 1.2.3 300.1.2.3.4",
    "4111 1111-1111 1111 4111111111111111 4111111111111112 12345678901234567890 4111--111111111111 5",
    "+1 2 3 4 5 6 7 8, +1234567 +12345678 +1(2)3-4.5 67 8) +1 " + "2" * 16 + " ++49 30 123456",
    "",
    None,
    "the daily word from nobody",
    "a1" * 2000 + " x@" + "y" * 2000 + ".z",
    "1 " * 30000,
    "a@b" + ".c" * 30000 + " " + "9" * 60000,
    "mail me@you.org. " * 1200,
] + [f"filler text number {'abcdefghij'[i % 10]} the writes" for i in range(60)]


def rows():
    return [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(None, TEXTS[0], None, None), (0, TEXTS[0], "y", 2)]


def test_report_equals_brute_force(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, base string, blob int")
    got = sorted(map(tuple, pii.report(docs).collect()), key=str)
    texts = [t for _, t, *_ in rows()]
    want = sorted(((i, *b) for (i, *_), b in zip(rows(), brute(texts))), key=str)
    assert got == want
    assert any("term:" in r[-1] for r in got)
    assert len({r[-1] for r in got}) > 8


def test_sanitised_texts_hold_no_entity(spark):
    docs = spark.createDataFrame(rows(), "doc_id bigint, text string, base string, blob int")
    clean = pii.sanitise(docs)
    assert clean.columns == docs.columns
    got = clean.collect()
    assert len(got) == len(rows())
    for r in got:
        assert not base_spans(r.text)
    one = next(r.text for r in got if r.doc_id == 1)
    assert "[EMAIL]" in one and "[PHONE]" in one and "Quixotry" not in one and one.startswith("two é🙂")
    assert {r.text for r in got if r.doc_id in (8, 9, 10)} == {TEXTS[8], TEXTS[9], TEXTS[10]}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert pii.report(docs).count() == 0
    assert pii.sanitise(docs).count() == 0


def test_long_runs_take_linear_time(spark):
    text = "a1" * 500000 + " x@" + "y" * 500000 + ".z " + "7" * 500000 + " " + "+1" + " " * 500000
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = pii.report(docs).first()
    assert (row.n_email, row.n_ip, row.n_card, row.n_phone) == (1, 0, 0, 0)


def test_values_that_never_recur_count_as_their_group(spark):
    texts = [f"Quixotry {w} writes from {w}{i}@corp.example.com" for i, w in enumerate(("one", "two", "three", "four"))]
    texts += [f"filler text number {i} the writes from" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    assert all("term:0:8" in spans[i].split(",") for i in range(4))
    assert not any(spans[i] for i in range(4, 64))


def test_terms_count_and_are_marked_in_the_whole_text(spark):
    gap = "plain filler words " * 20
    texts = [f"Quixotry's {w} file, {gap}call 5 or 6, write jane@corp.example.com {gap}(Quixotry) {w}" for w in ("one", "two", "three")]
    texts += ["Quixotry without an address"] + [f"plain filler words file call write {i}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}
    for i in range(3):
        at = texts[i].index("(Quixotry)") + 1
        marked = [tuple(map(int, p.split(":")[1:])) for p in spans[i].split(",") if p.startswith("term:")]
        assert {(0, 8), (at, at + 8)} <= set(marked)
        assert {texts[i][a:b] for a, b in marked} == {"Quixotry", "s", "or"}
    assert not any(spans[i] for i in range(3, len(texts)))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert not any("Quixotry" in clean[i] or "jane" in clean[i] for i in range(3))
    assert clean[3] == texts[3]


def test_a_term_beside_a_value_in_one_or_two_texts_is_marked(spark):
    filler = [f"an ordinary text about the weather in town number {i}" for i in range(400)]
    texts = ["Zephyrine wrote from jane@one.example about the weather in town"]
    texts += [f"the weather in town is what Ottoline reports to joan@two.example on day {i}" for i in (1, 2)]
    texts += ["在北京的 李明 wrote to an@three.example about 李明"]
    docs = spark.createDataFrame(list(enumerate(texts + filler)), "doc_id bigint, text string")
    spans = {r.doc_id: r.spans for r in pii.report(docs).collect()}

    def marked(i):
        parts = [p.split(":") for p in spans[i].split(",") if p.startswith("term:")]
        return {texts[i][int(a) : int(b)] for _, a, b in parts}

    assert "Zephyrine" in marked(0) and not marked(0) & {"weather", "town", "in", "about"}
    assert all("Ottoline" in marked(i) and not marked(i) & {"the", "weather", "town"} for i in (1, 2))
    assert "李明" in marked(3) and "about" not in marked(3)
    assert not any(spans[i] for i in range(len(texts), len(texts) + 400))


def test_disclosure_grows_with_evidence_and_falls_with_other_uses(spark):
    rows = spark.createDataFrame([(1.0, 1, 1), (3.0, 3, 3), (9.0, 9, 9), (1.0, 1, 2), (1.0, 1, 9)], "j double, e int, t int")
    found = rows.select(pii.disclosed(F.col("j"), F.lit(9), F.col("t"), 10_000)).collect()
    one, three, nine, other, many = [r[0] for r in found]
    assert 0 < many < other < one < three < nine < 1
