"""DuckDB SQL for the operators' queries, written apart from them."""

_ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_KINDS = [
    ("assign", _ASSIGN, 2, 12),
    ("access", "AKIA[A-Z0-9]+", 0, 18),
    ("hex", "[0-9a-f]+", 0, 16),
    ("private_key", "-----BEGIN(?: [A-Z]+)* PRIVATE KEY-----", 0, 0),
    ("code_host", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat", "xox[abeprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("cloud_key", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("payment", "[rs]k_live_[A-Za-z0-9]{16,}", 0, 0),
]
SECRET_SCAN = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), m AS ("
    + " UNION ALL ".join(
        f"""SELECT doc_id, {k} AS k, '{kind}' AS kind, unnest(ms) AS m, unnest(vs) AS v, unnest(gs[:len(ms)]) AS g, generate_subscripts(ms, 1) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{rx}') AS ms, regexp_extract_all(t, '{rx}', {group}) AS vs, string_split_regex(t, '{rx}') AS gs FROM d)
        """
        for k, (kind, rx, group, _) in enumerate(_KINDS)
    )
    + "), p AS (SELECT *, sum(length(g) + length(m)) OVER (PARTITION BY doc_id, k ORDER BY i) AS e FROM m), "
    + "s AS (SELECT doc_id, k, kind, (e - length(m))::BIGINT AS a, e::BIGINT AS b FROM p WHERE length(v) >= CASE k "
    + " ".join(f"WHEN {k} THEN {least}" for k, (_, _, _, least) in enumerate(_KINDS))
    + """ END), g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) FILTER (k < 3) AS base, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k) AS spans FROM s GROUP BY doc_id)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
    sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""
)

WARC_REASSEMBLY = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS keeper FROM p),
r AS (SELECT *, n >= 1000 AND page_id IS DISTINCT FROM keeper AS again FROM k)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN again THEN keeper END AS refers_to FROM r"""

LINE_DEDUP = """WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS unit FROM documents),
o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM l),
n AS (SELECT *, list_filter(string_split_regex(lower(line), '\\s+'), lambda w: w <> '') AS words FROM o),
u AS (SELECT doc_id, unit, start, start + length(line) AS "end", len(words) AS n_words, array_to_string(words, ' ') AS norm FROM n WHERE len(words) >= 20),
f AS (SELECT *, first_value(doc_id) OVER w AS keeper_doc_id, first_value(unit) OVER w AS keeper_unit FROM u WINDOW w AS (PARTITION BY norm ORDER BY doc_id, unit))
SELECT doc_id, unit::INTEGER AS unit, start, "end", n_words::INTEGER AS n_words, keeper_doc_id, keeper_unit::INTEGER AS keeper_unit FROM f WHERE (doc_id, unit) <> (keeper_doc_id, keeper_unit)"""

#: Holds for these tables' pages: one article a page, of headings and paragraphs, with two kinds of references in it.
HTML_EXTRACTION = r"""WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(?:</article>|$)', 1), '<[^>]*$', '') AS body FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(body, '</?(?:p|h1)>'), lambda x: trim(regexp_replace(
replace(regexp_replace(replace(regexp_replace(replace(x, '<br>', ' '), '<[^>]*>', '', 'g'), '&quot;', '"'), '&amp$', '&amp;'), '&amp;', '&'), '\s+', ' ', 'g'))) AS parts FROM a),
t AS (SELECT page_id, url, coalesce(array_to_string(list_filter(parts, lambda x: x <> ''), chr(10)), '') AS text FROM b)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM t"""

#: Codebooks of whole numbers: three assignments to the nearest entries, two rounds of means between them. Parts of 4 components.
_WHOLE = "len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _assigned(book: str) -> str:
    far = " + ".join(f"(s.x{k} - c.x{k}) * (s.x{k} - c.x{k})" for k in range(4))
    return f"SELECT r, p, min(({far}) * 64 + e) AS m FROM s JOIN {book} c USING (p) GROUP BY r, p"


def _means(book: str, assigned: str) -> str:
    means = ", ".join(f"floor(sum(x{k}) / count(*))::BIGINT AS x{k}" for k in range(4))
    kept = ", ".join(f"coalesce(n.x{k}, c.x{k}) AS x{k}" for k in range(4))
    return f"SELECT c.p, c.e, {kept} FROM {book} c LEFT JOIN (SELECT p, m % 64 AS e, {means} FROM {assigned} JOIN s USING (r, p) GROUP BY ALL) n USING (p, e)"


VECTOR_CODES = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND {_WHOLE}),
s AS MATERIALIZED (SELECT r, p, v[4 * p + 1] AS x0, v[4 * p + 2] AS x1, v[4 * p + 3] AS x2, v[4 * p + 4] AS x3 FROM k, range(16) t(p)),
c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x0, x1, x2, x3 FROM s WHERE r <= 64), a0 AS MATERIALIZED ({_assigned("c0")}),
c1 AS MATERIALIZED ({_means("c0", "a0")}), a1 AS MATERIALIZED ({_assigned("c1")}), c2 AS MATERIALIZED ({_means("c1", "a1")}), a2 AS MATERIALIZED ({_assigned("c2")}),
g AS (SELECT r, string_agg(format('{{:02x}}', m % 64), '' ORDER BY p) AS code, sum(m // 64)::BIGINT AS error FROM a2 GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
(SELECT sha256(string_agg(concat_ws(',', x0, x1, x2, x3), ',' ORDER BY p, e)) FROM c2) AS codebooks_sha256 FROM k JOIN g USING (r)"""

HARD_NEGATIVES = f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS l,
list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND {_WHOLE}),
s AS MATERIALIZED (SELECT a.r AS ar, a.id AS aid, a.l <> b.l AS far, b.r, b.id, list_dot_product(a.v, b.v)::BIGINT AS score FROM k a JOIN k b ON a.id % 100 = 0 AND a.r <> b.r),
p AS (SELECT * FROM s WHERE NOT far QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) <= 5)
SELECT p.aid AS anchor_id, p.id AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.ar = p.ar AND s.far AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.ar, p.r ORDER BY s.score DESC, s.id) QUALIFY row_number() OVER w <= 5"""
