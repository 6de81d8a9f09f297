"""SQL of the training-data queries that SQL can express (for DuckDB, on small tables)."""

from __future__ import annotations

from folioflow.llm import pii

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "[^\\x20\\x09-\\x0D]+"
_ALNUM = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(((('0x' || substr(h, {5 * g + 1}, 5))::BIGINT >> {s}) & 31) AS BIGINT), 1)"
    for g in range(8)
    for s in (15, 10, 5, 0)
)

WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages),
d AS (SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, sha1(x) AS h FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to
FROM m"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 33, 1))) AS i, w FROM d),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS s FROM p),
r AS (SELECT doc_id, i FROM x WHERE s IN (SELECT s FROM x GROUP BY s HAVING count(*) > 1)),
g AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS k FROM r),
l AS (SELECT doc_id, list(k) AS ks FROM g GROUP BY doc_id),
j AS (SELECT d.doc_id, w, coalesce(ks, []) AS ks FROM d LEFT JOIN l ON d.doc_id = l.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ks) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(ks, k)), lambda k: w[k]), ' '), '')) AS kept_sha256
FROM j"""

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_ALNUM}') AS w FROM benchmark),
bl AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bi AS (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bl),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s FROM bi),
sizes AS (SELECT DISTINCT n FROM bw),
di AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s FROM di),
o AS (SELECT dw.doc_id, dw.n, dw.i, bw.item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM o) GROUP BY doc_id),
t AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS items FROM o GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(len(items), 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id"""

JACCARD = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UP}', '{_LOW}'), '{_SPACE}') AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') || chr(10) || CASE WHEN len(w) < 5 THEN len(w) ELSE 5 END AS g FROM i),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
r AS (SELECT a AS x, b AS y FROM e UNION SELECT r.x, e.b FROM r JOIN e ON r.y = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(least(d.doc_id, (SELECT min(y) FROM r WHERE r.x = d.doc_id)), d.doc_id) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id"""

#: The contract's patterns, and those of the added kinds.
_PLAIN = {
    "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
    "ip": "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)",
    "card": "[0-9](?:[\\x20-]?[0-9])+",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
    "iban": pii._IBAN,
    "national_id": pii._NATIONAL,
}
_D = "regexp_replace(m, '[^0-9]', '', 'g')"
_TURNED = "array_to_string(list_transform(string_split(substr(replace(m, ' ', ''), 5) || substr(replace(m, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN c ELSE CAST(ascii(c) - 55 AS VARCHAR) END), '')"
_VALID = {
    "email": "true",
    "ip": "list_max(list_transform(string_split(m, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE coalesce(try_cast(ltrim(p, '0') AS INTEGER), 0) END)) <= 255",
    "card": f"length({_D}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_D}) + 1), lambda k: CASE WHEN k % 2 = 0 THEN (2 * CAST(substr(reverse({_D}), k, 1) AS INTEGER)) // 10 + (2 * CAST(substr(reverse({_D}), k, 1) AS INTEGER)) % 10 ELSE CAST(substr(reverse({_D}), k, 1) AS INTEGER) END)) % 10 = 0",
    "phone": f"length({_D}) BETWEEN 9 AND 15",
    "iban": f"length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_transform(string_split({_TURNED}, ''), lambda c: CAST(c AS INTEGER)), lambda a, c: (a * 10 + c) % 97) = 1 AND score >= {pii.LEAST}",
    "national_id": f"score >= {pii.LEAST}",
}


def _pii() -> str:
    parts = []
    for k, (kind, _, _, base, words) in enumerate(pii.KINDS):
        re = _PLAIN[kind]
        near = f"substr(t, CAST(greatest(s - {pii.NEAR}, 0) + 1 AS BIGINT), CAST(least(s, {pii.NEAR}) AS BIGINT)) || ' ' || substr(t, CAST(e + 1 AS BIGINT), {pii.NEAR})"
        parts.append(f"""
m{k} AS (SELECT doc_id, t, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(ps[1:len(ms)]) AS p FROM (SELECT doc_id, t, regexp_extract_all(t, '{re}') AS ms, string_split_regex(t, '{re}') AS ps FROM d)),
s{k} AS (SELECT *, sum(length(m) + length(p)) OVER (PARTITION BY doc_id ORDER BY i) AS e, sum(length(m) + length(p)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS s FROM m{k}),
v{k} AS (SELECT doc_id, {k} AS k, '{kind}' AS kind, m, s, e, least(1.0, {base} + CASE WHEN regexp_matches(lower({near}), '{words}') THEN {pii.LIFT} ELSE 0.0 END) AS score FROM s{k}),
f{k} AS (SELECT * FROM v{k} WHERE {_VALID[kind]})""")
    n = len(pii.KINDS)
    every = " UNION ALL ".join(f"SELECT * FROM f{k}" for k in range(n))
    counts = ", ".join(f"CAST(coalesce(count(*) FILTER (WHERE kind = '{kind[0]}'), 0) AS BIGINT) AS n_{kind[0]}" for kind in pii.KINDS)
    span = "kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),{",".join(parts)},
a AS ({every})
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg({span}, ',' ORDER BY k, s) FILTER (WHERE k < 4), '')) AS base_sha256,
       coalesce(string_agg({span}, ',' ORDER BY k, s) FILTER (WHERE kind IS NOT NULL), '') AS spans,
       coalesce(string_agg(printf('%.2f', score), ',' ORDER BY k, s) FILTER (WHERE kind IS NOT NULL), '') AS scores
FROM d LEFT JOIN a ON d.doc_id = a.doc_id GROUP BY d.doc_id"""


ORACLE_SQL = {"op1_warc": WARC, "op2_pii": _pii(), "op6_substring_dedup": SUBSTRING, "op7_decontamination": DECONTAMINATION, "op9_ngram_jaccard_join": JACCARD}
