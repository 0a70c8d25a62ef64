"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
SPACED = r"'[^\x20\x09-\x0D]+'"

WARC = """
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN least END AS refers_to
FROM (
    SELECT page_id, h, least, strlen(h) >= 100 AND page_id <> least AS again
    FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least FROM pages)
)
"""

PHRASES = f"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {SPACED}) AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(len(w) - 19)) AS i, w FROM words WHERE len(w) >= 20),
windows AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS phrase FROM starts),
again AS (
    SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY phrase ORDER BY doc_id, i) AS r FROM windows) WHERE r > 1
),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, range(20) AS s(k)),
places AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS word FROM words),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), {WORDS}) AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[i + 1:i + 5], ' ') AS s
    FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
),
links AS (
    SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 5 * c >= 4 * (p.n + q.n - c)
),
reach AS (SELECT x, y FROM links UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x)
SELECT doc_id, least(doc_id, coalesce(first, doc_id)) AS class_id, coalesce(n, 0)::BIGINT AS n_links
FROM documents
LEFT JOIN (SELECT x AS doc_id, min(y) AS first FROM reach GROUP BY x) USING (doc_id)
LEFT JOIN (SELECT x AS doc_id, count(*) AS n FROM links GROUP BY x) USING (doc_id)
"""

DECONTAMINATE = f"""
WITH items AS (SELECT item_id, regexp_extract_all(coalesce({LOWER}, ''), {WORDS}) AS w FROM benchmark),
phrases AS (
    SELECT DISTINCT item_id, least(len(w), 10) AS size, array_to_string(w[i + 1:i + least(len(w), 10)], ' ') AS phrase
    FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM items WHERE len(w) > 0)
),
docs AS (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), {WORDS}) AS w FROM documents),
windows AS (
    SELECT doc_id, i, size, array_to_string(w[i + 1:i + size], ' ') AS phrase
    FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM docs, (SELECT DISTINCT size FROM phrases) WHERE len(w) >= size)
),
hits AS (SELECT doc_id, i, size, item_id FROM windows JOIN phrases USING (size, phrase)),
covered AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS j FROM hits) GROUP BY doc_id),
found AS (
    SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(covered.n, 0)::BIGINT AS n_hit, coalesce(found.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, covered.n IS NOT NULL AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""

# The patterns as the contract gives them, without groups that capture.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b",
}
_DIGITS = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_LUHN = f"""list_sum(list_transform(range(1, len({_DIGITS}) + 1), lambda i:
    CASE WHEN (len({_DIGITS}) - i) % 2 = 0 THEN substr({_DIGITS}, i, 1)::INT
         ELSE (2 * substr({_DIGITS}, i, 1)::INT) // 10 + (2 * substr({_DIGITS}, i, 1)::INT) % 10 END)) % 10 = 0"""
_NUMERIC = """array_to_string(list_transform(string_split(substr(replace(x.m, ' ', ''), 5) || substr(replace(x.m, ' ', ''), 1, 4), ''),
    lambda c: CASE WHEN c <= '9' THEN c ELSE (ascii(c) - 55)::VARCHAR END), '')"""
VALID = {
    "email": "true",
    "ip": "len(list_filter(string_split(x.m, '.'), lambda p: len(ltrim(p, '0')) > 3 OR coalesce(try_cast(p AS HUGEINT), 0) > 255)) = 0",
    "card": f"len({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}",
    "phone": f"len({_DIGITS}) BETWEEN 9 AND 15",
    "iban": f"""list_reduce(list_prepend(0, list_transform(string_split({_NUMERIC}, ''), lambda c: c::INT)), lambda s, c: (s * 10 + c) % 97) = 1""",
}


def _pii() -> str:
    split = ", ".join(f"regexp_extract_all(t, '{p}') AS m_{k}, string_split_regex(t, '{p}') AS p_{k}" for k, p in PATTERNS.items())
    spans = ", ".join(
        f"""list_transform(list_filter(list_transform(range(1, len(m_{k}) + 1), lambda i: struct_pack(m := m_{k}[i],
            s := list_sum(list_transform(p_{k}[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m_{k}[1:i - 1], lambda y: length(y))), 0))),
            lambda x: {VALID[k]}), lambda x: concat_ws(':', '{k}', x.s::BIGINT, x.s::BIGINT + length(x.m))) AS {k}"""
        for k in PATTERNS
    )
    base = [k for k in PATTERNS if k != "iban"]
    joined = " || ".join(base)
    counts = ", ".join(f"len({k})::BIGINT AS n_{k}" for k in base)
    return f"""
WITH parts AS (SELECT doc_id, {split} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
spans AS (SELECT doc_id, {spans} FROM parts)
SELECT doc_id, {counts}, sha256(array_to_string({joined}, ',')) AS base_sha256, array_to_string({joined} || iban, ',') AS spans
FROM spans
"""


FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0"
WHOLE = "list_transform(embedding, lambda y: floor(256 * y::DOUBLE))"

HARD_NEGATIVES = f"""
WITH items AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, {WHOLE} AS x
    FROM embeddings WHERE label IS NOT NULL AND {FINITE}
),
positives AS (
    SELECT a.vec_id AS anchor_id, a.label, a.x, p.vec_id AS positive_id, list_dot_product(a.x, p.x)::BIGINT AS positive_score
    FROM items a JOIN items p ON a.label = p.label AND a.vec_id <> p.vec_id
    WHERE a.vec_id % 100 = 0
    QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.x, p.x) DESC, p.vec_id) <= 5
),
scored AS (
    SELECT anchor_id, positive_id, positive_score, n.vec_id AS negative_id, list_dot_product(p.x, n.x)::BIGINT AS negative_score
    FROM positives p JOIN items n ON p.label <> n.label
)
SELECT anchor_id, positive_id, (row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id))::INT AS rank,
       negative_id, positive_score, negative_score
FROM scored
WHERE 30 * positive_score <= 100 * negative_score AND 100 * negative_score <= 90 * positive_score
QUALIFY rank <= 10
"""


def _kmeans(centroids: int = 40, rounds: int = 5, width: int = 64) -> str:
    steps = []
    for r in range(rounds + 1):
        distance = "(list_dot_product(v.x, v.x) - 2 * list_dot_product(v.x, c.x) + list_dot_product(c.x, c.x))::BIGINT"
        steps.append(f"""a{r} AS MATERIALIZED (SELECT i, min({distance} * {centroids} + c) AS m FROM v, c{r} c GROUP BY i)""")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (
    SELECT c, k, sum(y::BIGINT) AS s, count(*) AS n FROM (SELECT m % {centroids} AS c, unnest(x) AS y, unnest(range({width})) AS k FROM a{r} JOIN v USING (i)) GROUP BY c, k
),
c{r + 1} AS MATERIALIZED (
    SELECT c, coalesce(z, x) AS x FROM c{r} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::DOUBLE ORDER BY k) AS z FROM s{r} GROUP BY c) USING (c)
)""")
    joined = ",\n".join(steps)
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, {WHOLE} AS x FROM embeddings WHERE len(embedding) = {width} AND {FINITE}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h) - 1 AS c, x FROM (SELECT x, sha256('2:' || vec_id) AS h FROM v ORDER BY h LIMIT {centroids})),
{joined}
SELECT vec_id, (m % {centroids})::INT AS cluster, m // {centroids} AS distance,
       (sum(m // {centroids}) OVER (PARTITION BY m % {centroids}))::BIGINT AS cluster_inertia, (sum(m // {centroids}) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.x, lambda y: y::BIGINT), ',')) AS centroid_sha256
FROM a{rounds} JOIN v USING (i) JOIN c{rounds} c ON c.c = m % {centroids}
"""


ORACLE: dict[str, str] = {
    "op1_warc": WARC,
    "op6_phrase_dedup": PHRASES,
    "op7_jaccard_join": JACCARD,
    "op8_decontaminate": DECONTAMINATE,
    "op9_pii": _pii(),
    "op11_kmeans": _kmeans(),
    "op12_hard_negatives": HARD_NEGATIVES,
}
