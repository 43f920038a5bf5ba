"""SQL, written from the definitions, for the queries that SQL can express."""

from __future__ import annotations

from tilewright.llm import lexicon_prints, secrets

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"'[^\x20\x09-\x0D]+'"

REPEATED_WORDS = rf"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents),
    win AS (SELECT doc_id, s, array_to_string(w[s:s + 49], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS s FROM d)),
    firsts AS (SELECT g, min(doc_id) AS low FROM win GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, unnest(generate_series(s, s + 49)) AS p FROM win JOIN firsts USING (g) WHERE low < doc_id),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) USING (doc_id)"""


def _item_words(text: str) -> str:
    return rf"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


PHRASES = f"""
    WITH d AS (SELECT doc_id, {_item_words('text')} AS w FROM documents),
    i AS (SELECT item_id, w, least(13, len(w)) AS k FROM (SELECT item_id, {_item_words('text')} AS w FROM benchmark) WHERE len(w) > 0),
    iw AS (SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT item_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM i)),
    dw AS (SELECT doc_id, k, s, array_to_string(w[s:s + k - 1], ' ') AS g FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS s FROM d, (SELECT DISTINCT k FROM i))),
    m AS (SELECT doc_id, item_id, k, s FROM dw JOIN iw USING (k, g)),
    h AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(generate_series(s, s + k - 1)) AS p FROM m) GROUP BY doc_id),
    t AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM m) GROUP BY doc_id)
    SELECT d.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
      coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(w) AS contaminated FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)"""


def _spans(order: int, rule: secrets.Rule) -> str:
    pattern = "'" + rule.pattern.replace("'", "''") + "'"
    size = lambda items, upto: f"coalesce(list_sum(list_transform({items}[1:{upto}], lambda x: length(x))), 0)"
    return f"""SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, {size('parts', 'n')} + {size('m', 'n - 1')} AS a, length(m[n]) AS l
      FROM (SELECT *, unnest(generate_series(1, len(m))) AS n FROM (SELECT doc_id, regexp_extract_all(t, {pattern}, 0) AS m, regexp_extract_all(t, {pattern}, {rule.group}) AS g,
      string_split_regex(t, {pattern}) AS parts FROM d)) WHERE length(g[n]) >= {rule.least}"""


SECRETS = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    f AS ({' UNION ALL '.join(_spans(order, rule) for order, rule in enumerate(secrets.BASE_RULES))}),
    s AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
      string_agg(concat(kind, ':', CAST(a AS BIGINT), ':', CAST(a + l AS BIGINT)), ',' ORDER BY a, o) AS spans FROM f GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
    FROM d LEFT JOIN s USING (doc_id)"""

NEAR_COPIES = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORD}) AS w FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, least(len(w), 1)))) AS s FROM d)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
    c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
    r(a, b) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, low AS component_id, d.doc_id = low AS kept
    FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a) USING (doc_id)"""

def _print_parts() -> str:
    """(f, base, p): each subset's number in turn, its level's first bit and size, and its part of the deal."""
    rows, at, below = [], 0, 36
    for bits, kept in lexicon_prints.LEVELS:
        below -= bits
        rows.append(f"SELECT {at} + j AS slot, {len(rows)} AS level, {kept} AS kept, j AS part, {1 << below} AS low, {1 << bits} AS parts FROM range({kept}) r(j)")
        at += kept
    return " UNION ALL ".join(rows)


def _alike(a: str, b: str, name: str) -> str:
    """(doc_id, name): equal signatures among the subsets that either print has, from levels that aren't full, else from all."""
    return f"""(SELECT doc_id, CASE WHEN sum(u) FILTER (WHERE 4 * u <= 3 * kept) > 0 THEN sum(m) FILTER (WHERE 4 * u <= 3 * kept) / CAST(sum(u) FILTER (WHERE 4 * u <= 3 * kept) AS DOUBLE)
        WHEN sum(u) > 0 THEN sum(m) / CAST(sum(u) AS DOUBLE) ELSE CAST(1 AS DOUBLE) END AS {name}
      FROM (SELECT e.doc_id, level, kept, count(*) FILTER (WHERE x.sig <> '' OR y.sig <> '') AS u, count(*) FILTER (WHERE x.sig = y.sig AND x.sig <> '') AS m
        FROM e JOIN sigs x ON x.k = {a} JOIN sigs y ON y.k = {b} AND y.slot = x.slot JOIN parts ON parts.slot = x.slot GROUP BY ALL) GROUP BY doc_id)"""


LEXICON_PRINTS = rf"""
    WITH parts AS ({_print_parts()}),
    o AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS next_id,
      coalesce(lead(coalesce(text, '')) OVER w, first_value(coalesce(text, '')) OVER w) AS nt FROM documents WINDOW w AS (ORDER BY doc_id DESC)),
    e AS (SELECT doc_id, n, next_id, substr(t, 1, n - n // 2) || substr(nt, 1, n // 2) AS edited, t FROM o),
    bodies AS (SELECT concat('o', doc_id) AS k, t AS body FROM e UNION ALL SELECT concat('e', doc_id), edited FROM e),
    terms AS (SELECT DISTINCT k, unnest({_item_words('body')}) AS term FROM bodies),
    band AS (SELECT term, CAST('0x' || substr(md5(term), 1, 9) AS BIGINT) AS deal FROM (SELECT term, count(*) AS c FROM terms WHERE k LIKE 'o%' GROUP BY term),
      (SELECT count(*) AS n FROM documents) WHERE c >= CAST(0.0002 AS DOUBLE) * n AND c - 2 <= CAST(0.01 AS DOUBLE) * n),
    held AS (SELECT k, slot, substr(md5(string_agg(term, ' ' ORDER BY term)), 1, 8) AS sig FROM terms JOIN band USING (term) JOIN parts ON deal // low % parts = part GROUP BY k, slot),
    sigs AS (SELECT k, slot, coalesce(sig, '') AS sig FROM (SELECT k, slot FROM bodies, parts) LEFT JOIN held USING (k, slot)),
    prints AS (SELECT k, string_agg(sig, '.' ORDER BY slot) AS p FROM sigs GROUP BY k)
    SELECT e.doc_id, n AS n_chars, sha256(edited) AS edited_sha256, a.p AS fingerprint, b.p AS edited_fingerprint, near_edited, near_next
    FROM e JOIN prints a ON a.k = concat('o', e.doc_id) JOIN prints b ON b.k = concat('e', e.doc_id)
    JOIN {_alike("concat('o', e.doc_id)", "concat('e', e.doc_id)", "near_edited")} USING (doc_id) JOIN {_alike("concat('o', e.doc_id)", "concat('o', e.next_id)", "near_next")} USING (doc_id)"""


def _round(n: int) -> str:
    """Centroids c{n} and nearest centroids a{n}, after round ``n``."""
    near = f"""a{n} AS MATERIALIZED (SELECT vec_id, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT vec_id, c, sum((x - y) * (x - y)) AS d FROM v JOIN c{n} USING (i) GROUP BY vec_id, c) GROUP BY vec_id)"""
    if n == 0:
        return near
    moved = f"""m{n} AS (SELECT c, i, sum(x) AS s, count(*) AS k FROM v JOIN a{n - 1} USING (vec_id) GROUP BY c, i),
    c{n} AS MATERIALIZED (SELECT c, i, CAST(coalesce((s - ((s % k) + k) % k) // k, y) AS BIGINT) AS y FROM c{n - 1} LEFT JOIN m{n} USING (c, i))"""
    return f"{moved}, {near}"


PIVOT_CLUSTERS = f"""
    WITH kept AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    v AS MATERIALIZED (SELECT vec_id, i, CAST(floor(64 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) r(i)),
    c0 AS MATERIALIZED (SELECT c, i, x AS y FROM (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM kept) JOIN v USING (vec_id) WHERE c < 16),
    {', '.join(_round(n) for n in range(4))},
    h AS (SELECT c, sha256(string_agg(CAST(y AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
      CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a3 JOIN h USING (c)"""

SOURCE_AUDIT = rf"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
    t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
    l AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
    cells AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    g AS (SELECT lang, source, coalesce(any_value(s.n), 0) AS n FROM d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM cells GROUP BY ALL) s USING (lang, source) GROUP BY ALL),
    p AS (SELECT g.lang, g.source, kept.term, coalesce(cells.n, 0) AS k, 1 + 1000000000 * (coalesce(cells.n, 0) + 5) // (g.n + 5 * v) AS p, 1 + 1000000000 * (total + 5) // (l.n + 5 * v) AS q
      FROM g JOIN kept USING (lang) JOIN l USING (lang) LEFT JOIN cells ON cells.lang = g.lang AND cells.source = g.source AND cells.term = kept.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE k > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM u)
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""

ORACLES = {
    "op1_repeated_words": REPEATED_WORDS,
    "op3_phrases": PHRASES,
    "op5_secrets": SECRETS,
    "op10_near_copies": NEAR_COPIES,
    "op11_lexicon_prints": LEXICON_PRINTS,
    "op12_pivot_clusters": PIVOT_CLUSTERS,
    "op13_source_audit": SOURCE_AUDIT,
}
