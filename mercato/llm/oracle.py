"""SQL for the queries that SQL can express, over the sample tables."""

from __future__ import annotations

#: Kind, pattern, least length of the value, group of the value.
SECRET_KINDS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)", 12, 2),
    ("access", r"AKIA[A-Z0-9]+", 18, 0),
    ("hex", r"[0-9a-f]+", 16, 0),
    (
        "key_block",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"
        r"(?:[^-]*(?:-{1,4}[^-]+)*-----END [A-Z ]{0,40}PRIVATE KEY-----"
        r"|(?:(?:\\[rn]|[\t\n\f\r\x20])*[A-Za-z0-9+/]{16,}={0,2})+(?:(?:\\[rn]|[\t\n\f\r\x20])+[A-Za-z0-9+/]+={1,2})?)?",
        1,
        0,
    ),
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 1, 0),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 1, 0),
)


def _found(number: int, pattern: str, least: int, group: int) -> str:
    """Rows (doc, number, start, end) of one kind."""
    return f"""
    SELECT r, {number} AS k, e - length(v) AS s, e FROM (
      SELECT r, unnest(hits) AS v, unnest(groups) AS g,
             unnest(list_transform(range(1, len(hits) + 1), lambda i:
               list_sum(list_transform(hits[1:i], lambda x: length(x)))
               + list_sum(list_transform(gaps[1:i], lambda x: length(x)))))::BIGINT AS e
      FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS hits,
                   regexp_extract_all(t, '{pattern}', {group}) AS groups,
                   regexp_split_to_array(t, '{pattern}') AS gaps FROM d)
    ) WHERE length(g) >= {least}"""


def secrets() -> str:
    parts = " UNION ALL ".join(
        _found(n, pattern, least, group) for n, (_, pattern, least, group) in enumerate(SECRET_KINDS)
    )
    names = "[" + ", ".join(f"'{k}'" for k, *_ in SECRET_KINDS) + "]"
    text = f"{names}[k + 1] || ':' || s || ':' || e"
    counts = ", ".join(
        f"count(*) FILTER (k = {n}) AS n_{kind}" for n, (kind, *_) in enumerate(SECRET_KINDS[:3])
    )
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    f AS ({parts}),
    g AS (SELECT r, {counts},
                 string_agg({text}, ',' ORDER BY s, k) FILTER (k < 3) AS base,
                 string_agg({text}, ',' ORDER BY s, k) AS spans FROM f GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
           coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
           coalesce(spans, '') AS spans
    FROM d LEFT JOIN g USING (r)"""


def quality_rules() -> str:
    return r"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (
      SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
      FROM d),
    windows AS (
      SELECT r, unnest(range(1, len(words) - 3)) AS i,
             unnest(list_transform(range(1, len(words) - 3), lambda i: words[i:i + 4])) AS win FROM w),
    again AS (
      SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM windows) WHERE n > 1),
    inside AS (
      SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM again) GROUP BY r),
    m AS (
      SELECT doc_id, len(words) AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             coalesce(n, 0) AS n_repeat_words,
             len(lines) AS n_lines,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
             length(t) - length(regexp_replace(t, '[A-Za-z]|[^\x00-\x7F]', '', 'g')) AS n_letters,
             length(t) - length(regexp_replace(t, '[^\x00-\x{7FF}]', '', 'g')) AS n_wide
      FROM w LEFT JOIN inside USING (r)),
    f AS (
      SELECT *, (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
        + 4 * (10 * n_symbols > 2 * n_words)::INT + 8 * (100 * n_dup_lines > 50 * n_lines)::INT
        + 16 * (100 * n_capitals > 40 * n_letters)::INT + 32 * (word_chars < 2 * n_words)::INT
        + 64 * (word_chars > 40 * n_words AND 2 * n_wide <= word_chars)::INT AS failed FROM m)
    SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
           n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
           (failed & 3) != 0 AS base_failed, failed = 0 AS kept, failed::BIGINT AS failed
    FROM f"""


def decontamination() -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
    WITH d AS (
      SELECT row_number() OVER () AS r, doc_id,
             regexp_extract_all({lower.format("coalesce(text, '')")}, '{pattern}') AS w FROM documents),
    b AS (
      SELECT coalesce(item_id::VARCHAR, '') AS item,
             regexp_extract_all({lower.format("coalesce(text, '')")}, '{pattern}') AS w FROM benchmark),
    bw AS (
      SELECT DISTINCT item, size, unnest(list_transform(range(1, len(w) - size + 2), lambda i:
               array_to_string(w[i:i + size - 1], ' '))) AS win
      FROM (SELECT *, least(13, len(w)) AS size FROM b WHERE len(w) > 0)),
    sizes AS (SELECT DISTINCT size FROM bw),
    dw AS (
      SELECT r, size, unnest(range(1, len(w) - size + 2)) AS i,
             unnest(list_transform(range(1, len(w) - size + 2), lambda i:
               array_to_string(w[i:i + size - 1], ' '))) AS win
      FROM d CROSS JOIN sizes),
    h AS (SELECT r, i, dw.size AS size, item FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
    n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM h) GROUP BY r),
    i AS (
      SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
      FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
           coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN n USING (r) LEFT JOIN i USING (r)"""


def archives() -> str:
    return """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
      FROM pages),
    f AS (
      SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
    SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
           CASE WHEN payload_bytes < 100 OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN payload_bytes < 100 OR page_id = first THEN NULL ELSE first END AS refers_to
    FROM f"""


def url_filters() -> str:
    number = "('0x' || substr(md5({}), 1, 6))::INT"
    return f"""
    WITH p AS (
      SELECT page_id, url, DATE '2024-01-01' + ({number.format("url")} % 366) AS fetched,
             rtrim(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)', 1), '.') AS host,
             list_filter(string_split(regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//[^/?#]*([^?#]*)', 1), '/'),
                         lambda s: s != '') AS path
      FROM pages),
    one AS (SELECT host AS entry, {number.format("host")} AS x FROM (SELECT DISTINCT host FROM p WHERE host != '')),
    below AS (
      SELECT entry, {number.format("entry")} AS x
      FROM (SELECT DISTINCT host || '/' || path[1] AS entry FROM p WHERE host != '' AND len(path) > 0)),
    domains AS (
      SELECT entry, {number.format("entry")} AS x
      FROM (SELECT DISTINCT array_to_string(string_split(host, '.')[-2:], '.') AS entry FROM p WHERE host != '')),
    spans AS (
      SELECT 'spam' AS list, entry, x % 200 AS since, 200 + x % 100 AS until FROM one WHERE x % 3 = 0
      UNION ALL SELECT 'spam', entry, 330, 100000 FROM one WHERE x % 6 = 0
      UNION ALL SELECT 'ads', entry, x % 300, 100000 FROM below WHERE x % 5 = 0
      UNION ALL SELECT 'allow', entry, x % 250, 100000 FROM one WHERE x % 7 = 0
      UNION ALL SELECT 'malware', entry, 300 + x % 30, 100000 FROM domains WHERE x % 9 = 0),
    m AS (
      SELECT DISTINCT url, fetched, list FROM p, spans
      WHERE (host || '/' || array_to_string(path, '/') || '/' = entry || '/'
             OR starts_with(host || '/' || array_to_string(path, '/') || '/', entry || '/')
             OR contains('.' || host || '/' || array_to_string(path, '/') || '/', '.' || entry || '/')
                AND NOT contains(entry, '/') AND ends_with('.' || host, '.' || entry)
             OR contains(entry, '/') AND ends_with('.' || host, '.' || split_part(entry, '/', 1))
                AND path[1] = split_part(entry, '/', 2))
        AND fetched - DATE '2024-01-01' >= since AND fetched - DATE '2024-01-01' < until),
    g AS (
      SELECT url, fetched, string_agg(list, ',' ORDER BY list) AS lists, bool_or(list = 'allow') AS allowed
      FROM m GROUP BY url, fetched)
    SELECT page_id, url, fetched, coalesce(lists, '') AS lists, lists IS NOT NULL AND NOT allowed AS blocked
    FROM p LEFT JOIN g USING (url, fetched)"""


def _crc32(text: str) -> str:
    """CRC-32 of ASCII text, bit by bit."""
    shifted = (
        "list_reduce(range(0, 8), lambda v, i:"
        " xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384::BIGINT ELSE 0::BIGINT END), xor(c, b))"
    )
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: ascii({text}[i])::BIGINT)"
    return f"xor(list_reduce({codes}, lambda c, b: {shifted}, 4294967295::BIGINT), 4294967295::BIGINT)"


def manifest() -> str:
    def framed(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    head = " || ".join(framed(c) for c in ("doc_id", "source", "lang", "n_chars"))
    levels = """
      SELECT tree, level + 1, rank // 3, sha256(string_agg(digest, '' ORDER BY rank)), (n + 2) // 3
      FROM {0} WHERE n > 1 GROUP BY tree, level, rank // 3, n"""
    siblings = """
      SELECT tree, level, rank, n,
             coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, rank // 3 ORDER BY rank
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
             coalesce(string_agg(digest, '') OVER (PARTITION BY tree, level, rank // 3 ORDER BY rank
                      ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
      FROM {0} WHERE n > 1"""
    return f"""
    WITH RECURSIVE d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, '') AS tree, coalesce(doc_id::VARCHAR, '1') AS id,
             sha256({head} || {framed("text")}) AS leaf,
             sha256({head} || {framed("replace(text, chr(10), '')")}) AS cut
      FROM documents),
    l AS (
      SELECT *, CASE WHEN {_crc32("id")} % 2 = 0 AND doc_id IS NOT NULL THEN cut ELSE leaf END AS given,
             row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS rank,
             count(*) OVER (PARTITION BY tree) AS n
      FROM d),
    t(tree, level, rank, digest, n) AS (
      SELECT tree, 0, rank, leaf, n FROM l UNION ALL {levels.format("t")}),
    s AS (
      SELECT tree, level AS height, digest AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place,
             count(*) OVER () AS trees
      FROM t WHERE n = 1),
    u(tree, level, rank, digest, n) AS (
      SELECT '', 0, place, subroot, trees FROM s UNION ALL {levels.format("u")}),
    lower AS ({siblings.format("t")}),
    upper AS ({siblings.format("u")}),
    p AS (
      SELECT r, lower.level AS level, before, after FROM l JOIN lower
        ON l.tree = lower.tree AND lower.rank = l.rank // (3 ** lower.level)::BIGINT
      UNION ALL
      SELECT r, 1000 + upper.level, before, after FROM l JOIN s ON l.tree = s.tree JOIN upper
        ON upper.rank = place // (3 ** upper.level)::BIGINT),
    g AS (
      SELECT r, list(before || '|' || after ORDER BY level) AS path,
             string_agg(before || after, '' ORDER BY level) AS siblings
      FROM p GROUP BY r),
    f AS (
      SELECT doc_id, leaf, subroot, (SELECT digest FROM u WHERE n = 1) AS root,
             sha256(coalesce(siblings, '')) AS proof_sha256,
             list_reduce(coalesce(path, []::VARCHAR[]), lambda a, x:
               sha256(split_part(x, '|', 1) || a || split_part(x, '|', 2)), given) AS folded_root
      FROM l JOIN s ON l.tree = s.tree LEFT JOIN g ON l.r = g.r)
    SELECT *, folded_root = root AS verified FROM f"""


def weighted_mix() -> str:
    place = "('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || turn), 1, 15))::BIGINT"
    return rf"""
    WITH RECURSIVE d AS (
      SELECT row_number() OVER () AS r, doc_id, coalesce('s' || source, 't') AS name,
             len(regexp_extract_all(coalesce(text, ''), '[^ 	-
]+'))::BIGINT AS size
      FROM documents),
    s AS (
      SELECT name, sum(size)::BIGINT AS source_size,
             [5, 2, 1][(row_number() OVER (ORDER BY name) - 1) % 3 + 1]::BIGINT AS weight
      FROM d GROUP BY name),
    shares(rest, weights, k) AS (
      SELECT sum(source_size)::BIGINT, sum(weight)::BIGINT, 0 FROM s
      UNION ALL
      SELECT ((SELECT sum(source_size) FROM s)
               - coalesce(sum(3 * source_size) FILTER (3 * source_size::HUGEINT * weights < rest::HUGEINT * weight), 0))::BIGINT,
             ((SELECT sum(weight) FROM s)
               - coalesce(sum(weight) FILTER (3 * source_size::HUGEINT * weights < rest::HUGEINT * weight), 0))::BIGINT,
             k + 1
      FROM shares, s WHERE k < 40 GROUP BY rest, weights, k),
    m AS (
      SELECT name, source_size,
             CASE WHEN 3 * source_size::HUGEINT * weights < rest::HUGEINT * weight THEN (3 * source_size)::DOUBLE
                  ELSE (rest * weight)::DOUBLE / greatest(weights, 1)::DOUBLE END AS target
      FROM s, shares WHERE k = 40),
    c AS (
      SELECT r, doc_id, name, size, target, turn, {place} AS place
      FROM (SELECT *, unnest(range(0, 3)) AS turn FROM d JOIN m USING (name) WHERE size > 0)),
    v AS (
      SELECT *, sum(size) OVER (PARTITION BY name ORDER BY turn, place, doc_id NULLS LAST, size, r
                                ROWS UNBOUNDED PRECEDING)::DOUBLE / target AS finish FROM c),
    o AS (
      SELECT r, size, sum(size) OVER (ORDER BY finish, name, turn, place, doc_id NULLS LAST, size, r
                                      ROWS UNBOUNDED PRECEDING) - size AS before FROM v),
    k AS (
      SELECT r, sum(greatest(least(size, (SELECT sum(size) FROM d) - before), 0))::BIGINT AS taken FROM o GROUP BY r)
    SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
    FROM d JOIN m USING (name) LEFT JOIN k ON d.r = k.r"""


def prefix_trie() -> str:
    return f"""
    WITH t AS (
      SELECT conv_id, turn, strlen(coalesce(text, '')) AS size,
             substr(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 1, 32) AS step
      FROM conversations WHERE conv_id IS NOT NULL),
    own AS (
      SELECT conv_id, list(step ORDER BY turn NULLS FIRST, step) AS steps,
             list(size ORDER BY turn NULLS FIRST, step) AS sizes, conv_id::VARCHAR AS id
      FROM t GROUP BY conv_id),
    h AS (SELECT *, ({_crc32("id")} % 9)::BIGINT AS shared FROM own),
    c AS (
      SELECT h.conv_id AS conv_id,
             list_concat(coalesce(b.steps, []::VARCHAR[])[1:shared], h.steps[shared + 1:]) AS steps,
             list_concat(coalesce(b.sizes, []::BIGINT[])[1:shared], h.sizes[shared + 1:]) AS sizes
      FROM h LEFT JOIN own AS b ON b.conv_id = h.conv_id - h.conv_id % 5),
    p AS (
      SELECT conv_id, len(steps) AS n, sizes[depth] AS size, depth, array_to_string(steps[1:depth], ',') AS node,
             CASE WHEN depth > 0 THEN array_to_string(steps[1:depth - 1], ',') END AS parent
      FROM (SELECT *, unnest(range(0, len(steps) + 1)) AS depth FROM c)),
    v AS (
      SELECT node, depth, parent, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(any_value(size), 0) AS size,
             string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth) AS ends
      FROM p GROUP BY node, depth, parent),
    k AS (SELECT parent AS node, count(*) AS n_children FROM v WHERE parent IS NOT NULL GROUP BY parent),
    w AS (
      SELECT v.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * size AS saved FROM v LEFT JOIN k USING (node)),
    below AS (
      SELECT array_to_string(string_split(node, ',')[1:up], ',') AS node, count(*) FILTER (n_children = 0) AS n_leaves,
             sum(saved) AS saved_tokens
      FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM w) GROUP BY 1)
    SELECT w.conv_id, w.depth::BIGINT AS depth, x.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs,
           w.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens,
           sha256(coalesce(w.ends, '')) AS ends_sha256
    FROM w JOIN below USING (node) LEFT JOIN v AS x ON x.node = w.parent"""


EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
#: Kind, pattern, which matches stay, group of the value; ``digits`` are those of the match.
PERSONAL_KINDS = (
    ("email", EMAIL, "true", "regexp_extract(v, '[^@]*$')"),
    (
        "ip",
        r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "list_bool_and(list_transform(string_split(v, '.'), lambda p: "
        "length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255))",
        r"regexp_replace(regexp_extract(v, '^[0-9]+\.[0-9]+'), '\b0+([0-9])', '\1', 'g')",
    ),
    (
        "card",
        r"[0-9](?:[\x20-]?[0-9])+",
        "length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length(digits) + 1), "
        "lambda i: CASE WHEN i % 2 = 1 THEN digits[-i]::INT "
        "ELSE 2 * digits[-i]::INT - CASE WHEN digits[-i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0",
        "digits[:6]",
    ),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) BETWEEN 8 AND 15", "digits[:4]"),
)
#: Letters with their accents; Chinese characters in pairs.
TERM = r"\p{Han}{1,2}|[^\P{L}\p{Han}][^\p{N}\p{P}\p{S}\p{Z}\p{C}\p{Han}]*"


def _placed(table: str, text: str, pattern: str) -> str:
    """Rows (b, i, gap, v, s, e): the i-th match of a text, its place, and the text before it."""
    before = "PARTITION BY b ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND"
    return f"""
    SELECT *, e - length(v) AS s FROM (
      SELECT *, (sum(length(gap)) OVER ({before} CURRENT ROW)
                 + sum(length(v)) OVER ({before} CURRENT ROW))::BIGINT AS e
      FROM (SELECT b, unnest(gaps) AS gap, unnest(hits) AS v, unnest(range(len(gaps))) AS i
            FROM (SELECT b, regexp_extract_all({text}, '{pattern}') AS hits,
                         regexp_split_to_array({text}, '{pattern}') AS gaps FROM {table})
            WHERE len(hits) > 0))"""


def personal_data(share: float = 0.8) -> str:
    """Base patterns over the whole texts, and co-occurrence counted pair by pair."""
    kinds = "[" + ", ".join(f"'{k}'" for k, *_ in PERSONAL_KINDS) + ", 'term']"
    base = " UNION ALL ".join(
        f"""SELECT b, {k} AS k, s, e, '{kind}:' || v AS value, '{kind} group:' || {group} AS grouped
        FROM (SELECT b, s, e, lower(v) AS v, regexp_replace(v, '[^0-9]', '', 'g') AS digits
              FROM ({_placed("texts", "t", pattern)}) WHERE v IS NOT NULL)
        WHERE {check}"""
        for k, (kind, pattern, check, group) in enumerate(PERSONAL_KINDS)
    )
    counts = ", ".join(
        f"count(*) FILTER (k = {k}) AS n_{kind}" for k, (kind, *_) in enumerate(PERSONAL_KINDS)
    )
    listed = ", ".join(f"coalesce(n_{kind}, 0)::BIGINT AS n_{kind}" for kind, *_ in PERSONAL_KINDS)
    span = f"{kinds}[k + 1] || ':' || s || ':' || e"

    def disclosed(joint: str, c_e: str) -> str:
        anywhere = f"({c_e} / n_all::DOUBLE)"
        return f"(ln((({joint} + {anywhere}) / (c_t + 1)) / {anywhere}) / ln(2)) / -(ln({anywhere}) / ln(2))"

    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    texts AS MATERIALIZED (SELECT row_number() OVER () AS b, t, count(*) AS n FROM d GROUP BY t),
    total AS (SELECT count(*) AS n_all FROM d),
    base AS MATERIALIZED ({base}),
    held AS (SELECT b, t, n FROM texts WHERE b IN (SELECT b FROM base)),
    plain AS (
      SELECT b, coalesce(p, t) AS t FROM held LEFT JOIN (
        SELECT b, string_agg(gap || repeat('0', coalesce(length(v), 0)), '' ORDER BY i) AS p
        FROM ({_placed("held", "t", EMAIL)}) GROUP BY b) USING (b)),
    words AS MATERIALIZED (
      SELECT b, s, e, translate(lower(v), 'ς', 'σ') AS term
      FROM ({_placed("plain", "t", TERM)}) WHERE v IS NOT NULL),
    spread AS (
      SELECT term, sum(n) AS c_t FROM (
        SELECT n, unnest(list_distinct(regexp_extract_all(
          translate(lower(regexp_replace(t, '{EMAIL}', '0', 'g')), 'ς', 'σ'), '{TERM}'))) AS term FROM texts)
      GROUP BY term),
    terms AS (
      SELECT b, n, term, c_t, n_all
      FROM (SELECT DISTINCT b, term FROM words) JOIN texts USING (b) JOIN spread USING (term), total),
    names AS (SELECT DISTINCT b, unnest([value, grouped]) AS entity FROM base),
    known AS (
      SELECT entity, count(*) AS held_by, sum(n) AS c_e FROM names JOIN texts USING (b)
      GROUP BY entity HAVING sum(n) < (SELECT n_all FROM total)),
    alone AS (SELECT DISTINCT b FROM names JOIN known USING (entity) WHERE held_by = 1),
    pairs AS (
      SELECT b, entity, term, n, c_e, c_t, n_all
      FROM terms JOIN names USING (b) JOIN known USING (entity) WHERE held_by > 1),
    risky AS (
      SELECT entity, term FROM pairs GROUP BY entity, term, c_e, c_t, n_all
      HAVING {disclosed("sum(n)", "c_e")} >= {share}),
    marked AS (
      SELECT b, term FROM terms JOIN alone USING (b) WHERE n < n_all AND {disclosed("n", "n")} >= {share}
      UNION SELECT b, term FROM pairs JOIN risky USING (entity, term)),
    f AS (SELECT b, k, s, e FROM base
          UNION ALL SELECT b, {len(PERSONAL_KINDS)}, s, e FROM words JOIN marked USING (b, term)),
    g AS (SELECT b, {counts},
                 string_agg({span}, ',' ORDER BY k, s) FILTER (k < {len(PERSONAL_KINDS)}) AS base,
                 string_agg({span}, ',' ORDER BY k, s) AS spans FROM f GROUP BY b)
    SELECT doc_id, {listed}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d JOIN texts USING (t) LEFT JOIN g USING (b)"""


SQL: dict[str, str] = {
    "op3_secret_scans": secrets(),
    "op4_url_filters": url_filters(),
    "op6_benchmark_decontamination": decontamination(),
    "op7_warc": archives(),
    "op9_quality_rules": quality_rules(),
    "op10_pii": personal_data(),
    "op11_merkle_manifest": manifest(),
    "op12_weighted_mix": weighted_mix(),
    "op13_prefix_trie": prefix_trie(),
}
