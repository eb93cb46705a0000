"""SQL counterparts of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def components(ids: str, links: str) -> str:
    """``reached(id, component_id)`` from nodes and links in either direction."""
    return f"""walk(id, other) AS (
  SELECT id, id FROM ({ids})
  UNION
  SELECT walk.id, links.b FROM walk JOIN ({links}) AS links ON links.a = walk.other),
reached AS (SELECT id, min(other) AS component_id FROM walk GROUP BY id)"""


NEAR_VECTORS = f"""
WITH RECURSIVE vectors AS MATERIALIZED (
  SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS size FROM embeddings
  WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS MATERIALIZED (
  SELECT p.vec_id AS a, q.vec_id AS b FROM vectors p JOIN vectors q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.v) = len(q.v)
  WHERE list_dot_product(p.v, q.v) / (p.size * q.size) >= 0.98),
{components('SELECT vec_id AS id FROM embeddings', 'SELECT a, b FROM pairs')},
counts AS (SELECT a AS id, count(*) AS n_links FROM pairs GROUP BY a)
SELECT id AS vec_id, coalesce(n_links, 0) AS n_links, component_id, id = component_id AS kept FROM reached LEFT JOIN counts USING (id)"""

JACCARD = f"""
WITH RECURSIVE split AS MATERIALIZED (SELECT doc_id, regexp_extract_all(coalesce({LOWER}, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM split)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM shingles p JOIN shingles q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY 1, 2),
pairs AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
{components('SELECT doc_id AS id FROM documents', 'SELECT a, b FROM pairs')}
SELECT id AS doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM reached LEFT JOIN sizes ON sizes.doc_id = id"""

REPEATS = f"""
WITH split AS MATERIALIZED (SELECT doc_id, {WORDS} AS w FROM documents),
windows AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - 11)) AS i FROM split WHERE len(w) >= 13)),
first AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN first USING (s) WHERE least < doc_id),
every AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word FROM split),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM split LEFT JOIN kept USING (doc_id)"""

TOP_PRODUCTS = """
WITH vectors AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= 10"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def secrets(base: list[tuple[str, str, str]], further: list[tuple[str, str, str]]) -> str:
    """Spans of the kinds ``(kind, expression, condition on hit)``, counted and joined."""
    parts = []
    for number, (kind, pattern, condition) in enumerate(base + further):
        parts.append(f"""
  SELECT doc_id, {number} AS k, '{kind}' AS kind, start, start + length(hit) AS stop FROM (
    SELECT doc_id, hits[i] AS hit, (list_sum(list_transform(between[1 : i], lambda x: length(x)))
      + coalesce(list_sum(list_transform(hits[1 : i - 1], lambda x: length(x))), 0))::BIGINT AS start
    FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (
      SELECT doc_id, regexp_extract_all(text, {_quoted(pattern)}) AS hits, string_split_regex(text, {_quoted(pattern)}) AS between FROM documents WHERE text IS NOT NULL)))
  WHERE {condition}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{kind}') AS n_{kind}" for kind, _, _ in base)
    zero = ", ".join(f"coalesce(n_{kind}, 0) AS n_{kind}" for kind, _, _ in base)
    one = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, k)"
    return f"""
WITH spans AS MATERIALIZED ({" UNION ALL ".join(parts)}),
sums AS (SELECT doc_id, {counts}, {one} FILTER (k < {len(base)}) AS base, {one} AS spans FROM spans GROUP BY doc_id)
SELECT doc_id, {zero}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN sums USING (doc_id)"""


TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

RANKED = f"""
WITH words AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER}, '{TERM}') AS w FROM documents WHERE text IS NOT NULL),
sized AS MATERIALIZED (SELECT doc_id, w, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
totals AS MATERIALIZED (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM sized),
asked AS MATERIALIZED (
  SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(regexp_extract_all({LOWER}, '{TERM}')) AS term FROM benchmark WHERE text IS NOT NULL)),
counted AS MATERIALIZED (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS term FROM sized) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS MATERIALIZED (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), totals),
scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // length)))))::BIGINT AS score
  FROM asked JOIN counted USING (term) JOIN weights USING (term), totals GROUP BY item_id, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranked WHERE rank <= 50"""


def _unsigned(group: int) -> str:
    return f"('0x' || substr(h, {8 * group + 1}, 8))::UBIGINT::BIGINT"


INFILL = f"""
WITH seeds AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT *, length(t)::BIGINT AS n, {_unsigned(0)} AS h1, {_unsigned(1)} AS h2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_unsigned(2)} % 100 >= 90 THEN 'plain'
         WHEN {_unsigned(3)} % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM seeds),
cut AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM drawn),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts"""
