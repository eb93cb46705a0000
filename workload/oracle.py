"""The registered queries as SQL for DuckDB."""

from __future__ import annotations

from textmill.functions.sentences import ABBREVIATIONS

WS = r"\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
CLOSERS = "\"''“”‘’)\\]"
ABBR = ", ".join(f"'{a}'" for a in ABBREVIATIONS)


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '\A[{WS}]+|[{WS}]+\z', '', 'g')"


def normalize(x: str) -> str:
    spaces = rf"regexp_replace({x}, '[\x{{a0}}\x{{202f}}]', ' ', 'g')"
    visible = rf"regexp_replace({spaces}, '[\x{{200b}}-\x{{200d}}\x{{feff}}]', '', 'g')"
    lines = rf"regexp_replace({visible}, '[ \t\f\r]*\n[ \t\f\r]*', chr(10), 'g')"
    return strip(rf"regexp_replace({lines}, '[ \t\f\r]+', ' ', 'g')")


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[^{WS}]+')"


def word_count(x: str) -> str:
    return f"len({words(x)})"


NOISY = r"""CASE doc_id % 5
  WHEN 0 THEN replace(text, ' ', chr(160))
  WHEN 1 THEN replace(text, ' ', '  ')
  WHEN 2 THEN text || chr(8203)
  WHEN 3 THEN replace(text, chr(10), ' ' || chr(13) || chr(10) || chr(9))
  ELSE text END"""

DOCS = f"docs AS (SELECT doc_id, {normalize('text')} AS t FROM documents)"

# Candidate pieces end on a terminator before whitespace; a piece that ends on an
# abbreviation runs on into the next one.
PIECES = rf"""
cand AS (
  SELECT doc_id, unnest(list_filter(string_split(
           regexp_replace(t, '([.!?][{CLOSERS}]*)([ \t\n\r]|\z)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')) AS p,
         unnest(range(len(list_filter(string_split(
           regexp_replace(t, '([.!?][{CLOSERS}]*)([ \t\n\r]|\z)', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: x <> '')))) AS o
  FROM docs),
flagged AS (
  SELECT *, regexp_matches(p, '[.!?][{CLOSERS}]*\z') AS ends,
         rtrim(lower(regexp_extract(p, '([\p{{L}}.]*)\.[{CLOSERS}]*\z', 1)), '.') IN ({ABBR}) AS abbr
  FROM cand),
grouped AS (
  SELECT *, coalesce(sum(CASE WHEN ends AND NOT abbr THEN 1 ELSE 0 END) OVER (
           PARTITION BY doc_id ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g
  FROM flagged),
pieces AS (
  SELECT doc_id, g::INTEGER AS ord, string_agg(p, '' ORDER BY o) AS piece, bool_or(ends AND NOT abbr) AS closed
  FROM grouped GROUP BY doc_id, g)"""


def pack(max_tokens: int, overlap: int) -> str:
    budget = max_tokens - overlap
    return rf"""
WITH RECURSIVE {DOCS}, {PIECES},
counted AS (SELECT doc_id, ord, piece, {word_count('piece')} AS tok, {words('piece')} AS w FROM pieces),
cut AS (
  SELECT doc_id, ord, 0 AS sub, piece AS txt, tok FROM counted WHERE tok <= {budget}
  UNION ALL
  SELECT doc_id, ord, i AS sub, ' ' || array_to_string(w[i + 1 : i + {budget}], ' ') AS txt, least({budget}, tok - i) AS tok
  FROM (SELECT *, unnest(range(0, tok, {budget})) AS i FROM counted WHERE tok > {budget})),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord, sub) - 1 AS n FROM cut),
longdocs AS (SELECT doc_id FROM docs WHERE {word_count('t')} > {max_tokens}),
todo AS (SELECT * FROM numbered WHERE doc_id IN (SELECT doc_id FROM longdocs)),
fold AS (
  SELECT doc_id, n, tok AS acc, 0 AS cid FROM todo WHERE n = 0
  UNION ALL
  SELECT p.doc_id, p.n,
         CASE WHEN f.acc > 0 AND f.acc + p.tok > (CASE WHEN f.cid = 0 THEN {max_tokens} ELSE {budget} END)
              THEN p.tok ELSE f.acc + p.tok END,
         CASE WHEN f.acc > 0 AND f.acc + p.tok > (CASE WHEN f.cid = 0 THEN {max_tokens} ELSE {budget} END)
              THEN f.cid + 1 ELSE f.cid END
  FROM fold f JOIN todo p ON p.doc_id = f.doc_id AND p.n = f.n + 1),
fresh AS (
  SELECT doc_id, cid, {strip("string_agg(txt, '' ORDER BY n)")} AS txt, sum(tok)::INTEGER AS tok
  FROM fold JOIN todo USING (doc_id, n) GROUP BY doc_id, cid),
prev AS (
  SELECT *, lag(txt) OVER (PARTITION BY doc_id ORDER BY cid) AS before FROM fresh),
chunks AS (
  SELECT doc_id, 0 AS chunk_index, t AS text, {word_count('t')}::INTEGER AS token_count, {word_count('t')}::INTEGER AS fresh_tokens
  FROM docs WHERE t <> '' AND {word_count('t')} <= {max_tokens}
  UNION ALL
  SELECT doc_id, cid,
         CASE WHEN before IS NULL OR {overlap} = 0 THEN txt
              ELSE array_to_string(list_reverse(list_reverse({words('before')})[1:{overlap}]), ' ') || ' ' || txt END,
         tok + CASE WHEN before IS NULL THEN 0 ELSE least({overlap}, {word_count('before')}) END::INTEGER, tok
  FROM prev)
"""


def exact(max_tokens: int, overlap: int) -> str:
    def count(x: str) -> str:
        return f"greatest(1, {word_count(x)})"

    return rf"""
WITH RECURSIVE {DOCS}, {PIECES},
ends AS (
  SELECT doc_id, closed, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY ord) AS b FROM pieces),
bounds AS (SELECT doc_id, list(b::BIGINT ORDER BY b) AS bs FROM ends WHERE closed GROUP BY doc_id),
longdocs AS (
  SELECT d.doc_id, d.t, length(d.t) AS n, coalesce(bs, []::BIGINT[]) AS bs
  FROM docs d LEFT JOIN bounds USING (doc_id) WHERE {word_count('t')} > {max_tokens}),
walk AS (
  SELECT doc_id, 0::BIGINT AS nxt, -1 AS idx, NULL::VARCHAR AS chunk, NULL::BIGINT AS tokens FROM longdocs
  UNION ALL
  SELECT doc_id,
         CASE WHEN fin THEN n ELSE greatest(stop - CASE WHEN stop < n
              THEN floor({overlap} * (least(stop, 500)::DOUBLE / {count("substr(t, greatest(0, stop - 500) + 1, least(stop, 500))")}))::BIGINT
              ELSE 0 END, nxt + 1) END,
         idx + 1,
         CASE WHEN fin THEN {strip('rest')} ELSE picked END,
         CASE WHEN fin THEN r ELSE picked_tokens END
  FROM (
    SELECT *, CASE WHEN k IS NULL THEN hard ELSE cands[k].c END AS picked,
           CASE WHEN k IS NULL THEN {count('hard')} ELSE cands[k].n END AS picked_tokens,
           CASE WHEN k IS NULL THEN hard_end + length(regexp_extract(substr(t, hard_end + 1), '^ *')) ELSE cands[k].e END AS stop
    FROM (
      SELECT *, list_position(list_transform(cands, lambda c: c.n <= {max_tokens}), true) AS k,
             array_to_string({words('rest')}[1:{max_tokens}], ' ') AS hard,
             nxt + length(array_to_string({words('rest')}[1:{max_tokens}], ' ')) AS hard_end
      FROM (
        SELECT *, list_transform(es, lambda e: struct_pack(e := e, c := {strip('substr(t, nxt + 1, e - nxt)')},
                    n := {count('substr(t, nxt + 1, e - nxt)')})) AS cands
        FROM (
          SELECT *, list_transform(sizes, lambda s: CASE
              WHEN len(list_filter(bs, lambda b: b > nxt AND b <= nxt + s)) > 0
                THEN list_max(list_filter(bs, lambda b: b > nxt AND b <= nxt + s))
              WHEN nxt + s >= n THEN n
              WHEN contains(substr(t, nxt + 2, s), ' ')
                THEN nxt + 1 + length(substr(t, nxt + 2, s)) - strpos(reverse(substr(t, nxt + 2, s)), ' ')
              WHEN strpos(substr(t, nxt + s + 1), ' ') > 0 THEN nxt + s + strpos(substr(t, nxt + s + 1), ' ') - 1
              ELSE n END) AS es
          FROM (
            SELECT *, list_reduce(range(20), lambda a, i: list_append(a, greatest(1, floor(a[-1] * 0.9::DOUBLE)::BIGINT)),
                     [least(floor({max_tokens} * (length(rest)::DOUBLE / r))::BIGINT, length(rest))]) AS sizes
            FROM (
              SELECT w.doc_id, w.nxt, w.idx, d.t, d.n, d.bs, substr(d.t, w.nxt + 1) AS rest,
                     {count('substr(d.t, w.nxt + 1)')} AS r, {count('substr(d.t, w.nxt + 1)')} <= {max_tokens} AS fin
              FROM walk w JOIN longdocs d USING (doc_id) WHERE w.nxt < d.n))))))),
numbered AS (
  SELECT doc_id, chunk, tokens, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS chunk_index
  FROM walk WHERE idx >= 0 AND chunk <> '')
SELECT doc_id, chunk_index::INTEGER AS chunk_index, chunk AS text, tokens::INTEGER AS token_count FROM numbered
UNION ALL
SELECT doc_id, 0, t, {word_count('t')}::INTEGER FROM docs WHERE t <> '' AND {word_count('t')} <= {max_tokens}
"""

# --- tables -------------------------------------------------------------------

CUSTOMER = """cust AS (
  SELECT c_custkey AS row_idx, [
    {'n': 'c_custkey', 'v': c_custkey::VARCHAR},
    {'n': 'c_name', 'v': CASE WHEN c_custkey % 11 = 0 THEN '  ' ELSE c_name END},
    {'n': 'c_nationkey', 'v': c_nationkey::VARCHAR},
    {'n': 'c_mktsegment', 'v': CASE WHEN c_custkey % 7 <> 0 THEN c_mktsegment ELSE '' END}] AS cells
  FROM customer)"""


def cell_text(names: bool, threshold: int) -> str:
    filled = "list_filter(cells, lambda c: trim(c.v) <> '')"
    values = f"array_to_string(list_transform({filled}, lambda c: c.v), ' | ')"
    named = f"array_to_string(list_transform({filled}, lambda c: c.n || ': ' || c.v), ' | ')"
    return f"trim(CASE WHEN len({filled}) <= {threshold} THEN {values} ELSE {named} END)" if names else f"trim({values})"


GAPPY = """gappy AS (
  SELECT o_orderstatus AS source_file, o_orderkey AS row_idx,
         CASE WHEN o_orderkey % 4 <> 0 THEN o_custkey::VARCHAR END AS custkey,
         CASE WHEN o_orderstatus <> 'P' AND o_orderkey % 3 <> 0 THEN o_orderpriority END AS priority
  FROM orders)"""

PARTS = """rows AS (
  SELECT p_type AS source_file, p_partkey AS row_idx,
         'p_name: ' || p_name || ' | p_brand: ' || p_brand || ' | p_size: ' || p_size AS t FROM part)"""

PART_NAMES = "rows AS (SELECT p_type AS source_file, p_partkey AS row_idx, p_name AS t FROM part)"

ORDERS = """cells_of AS (
  SELECT 'cust-' || o_custkey || '.xlsx' AS source_file, o_orderkey AS row_idx,
         o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority,
         count(*) OVER (PARTITION BY o_custkey) AS n_rows FROM orders)"""


def ratios(rows: str = "rows") -> str:
    """Characters per token of every source from a systematic sample of its non-empty rows."""
    return f"""
ranked AS (
  SELECT source_file, t, row_number() OVER (PARTITION BY source_file ORDER BY row_idx) - 1 AS rk,
         greatest(1, count(*) OVER (PARTITION BY source_file) // 100) AS step
  FROM {rows} WHERE t <> ''),
ratios AS (
  SELECT source_file, sum(length(t))::DOUBLE / sum(greatest(1, {word_count('t')})) AS ratio
  FROM ranked WHERE rk % step = 0 AND rk // step < 100 GROUP BY source_file)"""


def segments(max_tokens: int, prefix: str) -> str:
    """Rows cut into segments; ``rows`` has source_file, row_idx, t and what ``prefix`` needs."""
    return rf"""
sized AS (
  SELECT r.*, ratio, greatest(1, floor({max_tokens} * ratio)::BIGINT) AS cpc,
         length(t) <= floor({max_tokens} * ratio * 1.1::DOUBLE) OR greatest(1, floor(length(t) / ratio)) <= {max_tokens} AS fits
  FROM rows r JOIN ratios USING (source_file) WHERE t <> ''),
prefixed AS (SELECT *, {prefix} AS pre FROM sized WHERE NOT fits),
walk AS (
  SELECT source_file, row_idx, 0::BIGINT AS pos, 0::BIGINT AS nxt, -1 AS seg, NULL::VARCHAR AS txt FROM prefixed
  UNION ALL
  SELECT source_file, row_idx, nxt, nxt + k, seg + 1,
         CASE WHEN seg >= 0 THEN pre ELSE '' END || {strip('w[1:k]')}
  FROM (
    SELECT *, CASE WHEN nxt + length(w) < length(t) AND strpos(reverse(w), ' ') > 0 AND strpos(reverse(w), ' ') < length(w)
                   THEN length(w) - strpos(reverse(w), ' ') + 1 ELSE length(w) END AS k
    FROM (
      SELECT x.source_file, x.row_idx, x.nxt, x.seg, p.t, p.pre,
             substr(p.t, x.nxt + 1, CASE WHEN x.seg < 0 THEN p.cpc ELSE greatest(1, p.cpc - length(p.pre), p.cpc // 2) END) AS w
      FROM walk x JOIN prefixed p USING (source_file, row_idx) WHERE x.nxt < length(p.t)))),
all_segments AS (
  SELECT source_file, row_idx, 0 AS seg, t AS text, false AS row_split FROM sized WHERE fits
  UNION ALL
  SELECT source_file, row_idx, seg, txt, true FROM walk WHERE seg >= 0 AND txt <> ''),
chunked AS (
  SELECT source_file, row_idx, (row_number() OVER (PARTITION BY source_file ORDER BY row_idx, seg) - 1)::INTEGER AS chunk_index,
         text, greatest(1, floor(length(text) / ratio))::INTEGER AS token_count, NOT row_split AS single_row, row_split,
         true AS is_tabular
  FROM all_segments JOIN ratios USING (source_file))"""


DOC_CELLS = """[{'n': 'doc_id', 'v': doc_id::VARCHAR}, {'n': 'lang', 'v': CASE WHEN doc_id % 3 <> 0 THEN lang ELSE '' END},
    {'n': 'text', 'v': text}]"""


def prefix_of(cells: str, cpc: str) -> str:
    parts = (
        f"list_transform(list_filter({cells}, lambda c: {strip('c.v')} <> '' AND length({strip('c.v')}) <= ({cpc}) // 3), "
        f"lambda c: c.n || ': ' || {strip('c.v')})"
    )
    sums = f"list_transform(range(1, len({parts}) + 1), lambda i: list_sum(list_transform({parts}[1:i], lambda p: length(p) + 3)))"
    kept = f"{parts}[1:len(list_filter({sums}, lambda s: s <= ({cpc}) // 4))]"
    return f"array_to_string(list_transform({kept}, lambda p: p || ' | '), '')"


def pack_from(docs: str, max_tokens: int, overlap: int, key: str = "doc_id") -> str:
    """The packing statement over another set of texts with columns doc_id and t."""
    return pack(max_tokens, overlap).replace(DOCS, docs)


TURNS = f"""docs AS (
  SELECT 'conv-' || conv_id AS doc_id, {normalize("'message' || chr(10) || string_agg(text, chr(10) ORDER BY turn)")} AS t
  FROM conversations GROUP BY conv_id)"""

TURN_TABLES = """turns AS (
  SELECT 'conv-' || conv_id || '.csv' AS source_file, turn AS row_idx, count(*) OVER (PARTITION BY conv_id) AS n_rows,
         [{'n': 'turn', 'v': turn::VARCHAR}, {'n': 'role', 'v': role}, {'n': 'text', 'v': text}] AS cells FROM conversations)"""

LINE_TABLES = """lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
line_rows AS (
  SELECT doc_id || '.csv' AS source_file, i AS row_idx, nullif(x, '') AS x, i::VARCHAR AS no,
         count(*) OVER (PARTITION BY doc_id) AS n_rows,
         count(nullif(x, '')) OVER (PARTITION BY doc_id) > 0 AS has_line,
         [{'n': 'line', 'v': x}, {'n': 'no', 'v': i::VARCHAR}] AS cells FROM lines)"""


def gated(tables: str, rows: str, header: str, values: str, min_rows: int, max_tokens: int, overlap: int, threshold: int) -> str:
    """Tables with enough rows as row chunks, the others as packed text."""
    texts = f"""docs AS (
  SELECT source_file AS doc_id, {normalize(f"'{header}' || chr(10) || string_agg({values}, chr(10) ORDER BY row_idx)")} AS t
  FROM {rows} WHERE n_rows < {min_rows} GROUP BY source_file)"""
    packed = pack(max_tokens, overlap).replace(DOCS, f"{tables}, {texts}")
    return f"""{packed},
rows AS (SELECT *, {cell_text(True, threshold)} AS t FROM {rows} WHERE n_rows >= {min_rows}),
{ratios()}, {segments(max_tokens, prefix_of('cells', 'cpc')).replace('walk', 'row_walk')}
"""


EVENT_SHEETS = """sheets AS (
  SELECT event_type AS source_file, event_id AS row_idx,
         event_id % 1500 < 130 + 40 * length(event_type) AND event_id > 600 AS sparse, user_id::VARCHAR AS user_id FROM events)"""

# --- models -------------------------------------------------------------------

_RETRIEVAL = "Represent this sentence for searching relevant passages: "
MODELS = f"""models(model_name, model_id, max_length, language, dimension, query_prefix, passage_prefix, pos) AS (VALUES
  ('all-MiniLM-L6-v2', 'sentence-transformers/all-MiniLM-L6-v2', 256, 'en', 384, '', '', 1),
  ('paraphrase-multilingual-MiniLM-L12-v2', 'sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2', 128, 'multi', 384, '', '', 2),
  ('all-mpnet-base-v2', 'sentence-transformers/all-mpnet-base-v2', 384, 'en', 768, '', '', 3),
  ('bge-base-en-v1.5', 'BAAI/bge-base-en-v1.5', 512, 'en', 768, '{_RETRIEVAL}', '', 4),
  ('bge-large-en-v1.5', 'BAAI/bge-large-en-v1.5', 512, 'en', 1024, '{_RETRIEVAL}', '', 5),
  ('BAAI/bge-m3', 'BAAI/bge-m3', 8192, 'multi', 1024, '', '', 6),
  ('multilingual-e5-large', 'intfloat/multilingual-e5-large', 512, 'multi', 1024, 'query: ', 'passage: ', 7),
  ('e5-base-v2', 'intfloat/e5-base-v2', 512, 'en', 768, 'query: ', 'passage: ', 8),
  ('e5-large-v2', 'intfloat/e5-large-v2', 512, 'en', 1024, 'query: ', 'passage: ', 9))"""

REQUESTS = """requests AS (
  SELECT doc_id, text, (['all-MiniLM-L6-v2', 'paraphrase-multilingual-MiniLM-L12-v2', 'bge-base-en-v1.5',
         'multilingual-e5-large', 'e5-base-v2', 'my/own-model'])[doc_id % 6 + 1] AS model_name,
         CASE WHEN doc_id % 2 = 0 THEN 'query' ELSE 'passage' END AS prefix_mode FROM documents)"""

INPUTS = f"""inputs AS (
  SELECT doc_id, model_name, coalesce(max_length, 512) AS max_length,
         CASE WHEN prefix_mode = 'query' THEN coalesce(query_prefix, '') ELSE coalesce(passage_prefix, '') END || text AS t
  FROM requests LEFT JOIN models USING (model_name)),
cut_inputs AS (
  SELECT doc_id, model_name, {word_count('t')} > max_length AS truncated,
         CASE WHEN {word_count('t')} > max_length THEN array_to_string({words('t')}[1:max_length], ' ') ELSE t END AS input_text
  FROM inputs)"""

# --- results ------------------------------------------------------------------

FILES = """files AS (
  SELECT doc_id, 'doc-' || doc_id || (['.txt', '.TXT', '.docx', '.pdf', '.png', ''])[doc_id % 6 + 1] AS source_file,
         (['.txt', '.txt', '.docx', '.pdf', '.png', ''])[doc_id % 6 + 1] AS file_ext, text, source AS container_file, n_chars FROM documents),
bad AS (
  SELECT source_file,
         CASE WHEN n_chars > 9000 THEN 'FILE_TOO_LARGE' ELSE 'UNSUPPORTED_FORMAT' END AS error_code,
         CASE WHEN n_chars > 9000 THEN 'Dosya ''' || source_file || ''' boyutu limiti aşıyor: 0MB'
              ELSE 'Unsupported file format: ''' || file_ext || ''' (file: ' || source_file || ')' END AS message,
         NULL::VARCHAR AS detail
  FROM files WHERE n_chars > 9000 OR file_ext IN ('.png', ''))"""

GOOD_DOCS = f"""{FILES},
docs AS (SELECT doc_id, {normalize('text')} AS t FROM files WHERE source_file NOT IN (SELECT source_file FROM bad))"""

RESULT_CHUNKS = pack_from(GOOD_DOCS, 128, 16)

ALL_DOCS = f"""{FILES},
docs AS (SELECT doc_id, {normalize("CASE WHEN doc_id % 11 <> 5 THEN text ELSE ' ' || chr(10) END")} AS t FROM files)"""

ALL_CHUNKS = pack_from(ALL_DOCS, 128, 16)


def float_hex(v: str) -> str:
    """Bytes of a whole number from 0 to 2 ** 23 as a little-endian 32-bit float, in hex."""
    e = f"(length(bin({v}::BIGINT)) - 1)"
    bits = f"(CASE WHEN {v} = 0 THEN 0 ELSE ((127 + {e}) << 23) + (({v}::BIGINT - (1::BIGINT << {e})) << (23 - {e})) END)"
    return " || ".join(f"format('{{:02X}}', ({bits} >> {8 * i}) & 255)" for i in range(4))


# Chunks of each document as a matrix file: magic, version, length of the header, header, rows.
MATRICES = pack(256, 32) + f""",
tokens AS (
  SELECT doc_id, chunk_index, unnest({words("'passage: ' || text")}) AS w FROM chunks),
slots AS (
  SELECT doc_id, chunk_index, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot, count(*) AS n FROM tokens GROUP BY ALL),
cells AS (SELECT doc_id, chunk_index, text, unnest(range(64)) AS slot FROM chunks),
vectors AS (
  SELECT doc_id, chunk_index, any_value(text) AS text, string_agg({float_hex('coalesce(n, 0)')}, '' ORDER BY slot) AS digits
  FROM cells LEFT JOIN slots USING (doc_id, chunk_index, slot) GROUP BY doc_id, chunk_index),
matrices AS (
  SELECT doc_id::VARCHAR AS filename, count(*)::INTEGER AS n_chunks, list(text ORDER BY chunk_index) AS texts,
    '934E554D505901007600'
    || hex(rpad('{{''descr'': ''<f4'', ''fortran_order'': False, ''shape'': (' || count(*) || ', 64), }}', 117, ' ')) || '0A'
    || string_agg(digits, '' ORDER BY chunk_index) AS npy
  FROM vectors GROUP BY doc_id)
"""

# --- sources ------------------------------------------------------------------

MEMBERS = """manifest AS (
  SELECT source || '.zip' AS archive, doc_id AS ordinal, doc_id % 13 = 0 AS is_dir,
         CASE WHEN doc_id % 13 = 0 THEN 'folder-' || doc_id || '/' WHEN doc_id % 17 = 0 THEN 'in-' || doc_id || '.zip'
              ELSE 'doc-' || doc_id || (['.txt', '.TXT', '.docx', '.pdf', '.png', ''])[doc_id % 6 + 1] END AS member,
         n_chars * CASE WHEN substr(source, 4)::INTEGER % 5 = 0 THEN 1000 ELSE 1 END AS file_size,
         CASE WHEN substr(source, 4)::INTEGER % 7 = 3 AND doc_id % 3 = 0 THEN 1 ELSE 0 END AS flag_bits
  FROM documents),
verdicts AS (
  SELECT archive, sum(CASE WHEN is_dir THEN 0 ELSE file_size END) AS total, max(flag_bits) AS enc FROM manifest GROUP BY archive)"""

LINES = """blocks AS (
  SELECT doc_id::VARCHAR AS doc, o AS ord, o % 3 = 0 AS par,
         CASE WHEN o % 4 = 1 THEN ' ' || x ELSE x END AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(len(string_split(text, chr(10))))) AS o FROM documents))"""


ORACLE = {
    "normalize_text": f"""
SELECT doc_id, {normalize('r')} AS plain, lower({normalize('r')}) AS lowered
FROM (SELECT doc_id, {NOISY} AS r FROM documents)""",
    # DuckDB raises the sharp s to a capital one, the rule to SS.
    "normalize_upper": f"""
SELECT conv_id, turn, upper(replace({normalize('r')}, 'ß', 'ss')) AS raised
FROM (SELECT conv_id, turn, chr(65279) || ' ' || replace(text, ' ', chr(9) || ' ') || ' ' || chr(10) AS r FROM conversations)""",
    "token_counts": f"SELECT doc_id, greatest(1, {word_count('text')})::INTEGER AS token_count FROM documents",
    "sentences": f"WITH {DOCS}, {PIECES} SELECT doc_id, ord, piece FROM pieces",
    "sentence_offsets": f"""
WITH {DOCS}, {PIECES}
SELECT doc_id, bound FROM (
  SELECT doc_id, closed, (sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY ord))::INTEGER AS bound FROM pieces)
WHERE closed""",
    "snap_asof": f"""
WITH {DOCS}, {PIECES},
bounds AS (
  SELECT doc_id, bound FROM (
    SELECT doc_id, closed, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY ord) AS bound FROM pieces) WHERE closed),
targets AS (SELECT doc_id, unnest(range(0, greatest(1, length(t)), 400)) AS start FROM docs),
found AS (
  SELECT x.doc_id, x.start, x.start + 400 AS target, b.bound
  FROM targets x ASOF LEFT JOIN bounds b ON b.doc_id = x.doc_id AND b.bound <= x.start + 400)
SELECT doc_id, start::INTEGER AS start, target::INTEGER AS target,
       (CASE WHEN bound > start THEN bound END)::INTEGER AS snapped FROM found""",
    "chunk_pack": pack(512, 100) + "SELECT doc_id, chunk_index, text, token_count FROM chunks",
    "chunk_overlap": pack(128, 32) + "SELECT doc_id, chunk_index, text, token_count, fresh_tokens FROM chunks",
    "hard_cut": pack(16, 0) + "SELECT doc_id, chunk_index, text, token_count FROM chunks",
    "chunk_exact": exact(512, 100),
    "single_chunk_docs": f"""
WITH {DOCS} SELECT {word_count('t')} <= 512 AS fits, count(*) AS n_docs FROM docs GROUP BY 1""",
    "row_text": f"WITH {CUSTOMER} SELECT row_idx, {cell_text(True, 2)} AS row_text FROM cust",
    "row_text_bare": f"WITH {CUSTOMER} SELECT row_idx, lower({cell_text(False, 2)}) AS row_text FROM cust",
    "row_text_values_only": f"WITH {CUSTOMER} SELECT row_idx, {cell_text(True, 3)} AS row_text FROM cust",
    "row_text_column": "SELECT p_partkey, upper(trim(p_name)) AS row_text FROM part",
    "row_map": f"""
WITH {CUSTOMER} SELECT row_idx, list_transform(cells, lambda c: c.n) AS names, list_transform(cells, lambda c: c.v) AS vals FROM cust""",
    "drop_null_columns": f"WITH {GAPPY} SELECT * FROM gappy",
    "drop_blank_rows": f"WITH {GAPPY} SELECT * FROM gappy WHERE custkey IS NOT NULL OR priority IS NOT NULL",
    "reindexed_rows": f"""
WITH {GAPPY} SELECT source_file, row_idx, row_number() OVER (PARTITION BY source_file ORDER BY row_idx) - 1 AS dense_idx
FROM gappy WHERE custkey IS NOT NULL OR priority IS NOT NULL""",
    "table_profile": f"""
WITH {GAPPY} SELECT source_file, count(*) AS n_rows, count(*) FILTER (custkey IS NOT NULL OR priority IS NOT NULL) AS n_text,
  CASE WHEN count(custkey) > 0 THEN ['custkey'] ELSE [] END || CASE WHEN count(priority) > 0 THEN ['priority'] ELSE [] END AS kept
FROM gappy GROUP BY source_file""",
    "sparse_run_cut": f"""
WITH {EVENT_SHEETS},
g AS (SELECT *, sum((NOT sparse)::INTEGER) OVER (PARTITION BY source_file ORDER BY row_idx) AS g FROM sheets),
r AS (SELECT *, sum(sparse::INTEGER) OVER (PARTITION BY source_file, g ORDER BY row_idx) AS run FROM g),
cut AS (SELECT source_file, min(row_idx) AS cut FROM r WHERE sparse AND run >= 50 GROUP BY source_file)
SELECT source_file, row_idx, user_id FROM sheets LEFT JOIN cut USING (source_file)
WHERE NOT sparse AND (cut IS NULL OR row_idx < cut)""",
    "table_gate": f"WITH {ORDERS} SELECT source_file, count(*) AS n_rows, count(*) >= 8 AS is_table FROM cells_of GROUP BY source_file",
    "row_cap": f"WITH {ORDERS} SELECT source_file, row_idx, o_orderkey, o_orderstatus, o_orderpriority FROM cells_of WHERE n_rows <= 12",
    "row_cap_errors": f"""
WITH {ORDERS} SELECT DISTINCT source_file, 'TOO_MANY_ROWS' AS error_code,
  'Dosya ''' || source_file || ''' çok fazla satır içeriyor: ' || n_rows || ' (limit: 12)' AS message, NULL::VARCHAR AS detail
FROM cells_of WHERE n_rows > 12""",
    "char_token_ratio": f"WITH {PARTS}, {ratios()} SELECT source_file, ratio FROM ratios",
    "char_token_ratio_column": f"WITH {PART_NAMES}, {ratios()} SELECT source_file, ratio FROM ratios",
    "row_chunks": f"""
WITH RECURSIVE {CUSTOMER}, rows AS (SELECT 'customer.csv' AS source_file, row_idx, cells, {cell_text(True, 2)} AS t FROM cust),
{ratios()}, {segments(8, prefix_of('cells', 'cpc'))}
SELECT *, 'csv' AS table_type FROM chunked""",
    "row_split": f"""
WITH RECURSIVE rows AS (
  SELECT *, {cell_text(True, 2)} AS t FROM (
    SELECT source || '.csv' AS source_file, doc_id AS row_idx, {DOC_CELLS} AS cells FROM documents)),
{ratios()}, {segments(128, prefix_of('cells', 'cpc'))}
SELECT *, 'csv' AS table_type FROM chunked""",
    "row_split_bare": f"""
WITH RECURSIVE rows AS (
  SELECT *, lower({cell_text(False, 2)}) AS t FROM (
    SELECT source || '.csv' AS source_file, doc_id AS row_idx, {DOC_CELLS} AS cells FROM documents)),
{ratios()}, {segments(64, "''")}
SELECT *, 'excel' AS table_type FROM chunked""",
    "context_prefix": f"""
SELECT row_idx, {prefix_of('cells', '400 + row_idx % 300')} AS prefix
FROM (SELECT doc_id AS row_idx, {DOC_CELLS} AS cells FROM documents)""",
    "row_metadata": f"""
WITH {CUSTOMER} SELECT (row_number() OVER (ORDER BY row_idx) - 1)::INTEGER AS chunk_index, cells[2].v AS data_name, cells[4].v AS data_segment,
  cells[3].v AS root_nation, len(cells)::INTEGER AS n_cells, list_transform(cells, lambda c: c.n) AS table_columns FROM cust""",
    "unstructured_fallback": pack_from(TURNS, 96, 24) + """
SELECT doc_id AS source_file, chunk_index, text, token_count, false AS is_tabular, true AS sentence_aware FROM chunks""",
    "chunk_tables": f"""
WITH RECURSIVE {ORDERS},
rows AS (
  SELECT source_file, row_idx, n_rows,
         'o_orderkey: ' || o_orderkey || ' | o_orderstatus: ' || o_orderstatus || ' | o_orderpriority: ' || o_orderpriority AS t
  FROM cells_of WHERE n_rows >= 8),
{ratios()}, {segments(512, "''")},
texts AS (
  SELECT source_file, 'o_orderkey | o_orderstatus | o_orderpriority' || chr(10) || string_agg(
           o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority, chr(10) ORDER BY row_idx) AS t
  FROM cells_of WHERE n_rows < 8 GROUP BY source_file)
SELECT source_file, chunk_index, text, token_count, true AS is_tabular, false AS sentence_aware, 'excel' AS table_type FROM chunked
UNION ALL
SELECT source_file, 0, t, {word_count('t')}::INTEGER, false, true, NULL FROM texts""",
    "chunk_tables_turns": gated(
        TURN_TABLES, "turns", "turn | role | text", "cells[1].v || ' | ' || cells[2].v || ' | ' || cells[3].v", 6, 48, 8, 2
    )
    + """
SELECT source_file, chunk_index, text, token_count, true AS is_tabular, row_split FROM chunked
UNION ALL SELECT doc_id, chunk_index, text, token_count, false, false FROM chunks""",
    "table_files": f"""
WITH {LINE_TABLES} SELECT source_file, row_idx, ['line', 'no'] AS names, [x, no] AS vals FROM line_rows""",
    "chunk_table_files": gated(
        LINE_TABLES, "line_rows", "line | no", "coalesce(x, '') || ' | ' || no", 5, 24, 4, 1
    )
    + """
SELECT source_file, chunk_index, text, token_count, true AS is_tabular, row_split,
  (SELECT CASE WHEN any_value(has_line) THEN 2 ELSE 1 END FROM line_rows l WHERE l.source_file = chunked.source_file)::INTEGER AS n_columns
FROM chunked
UNION ALL SELECT doc_id, chunk_index, text, token_count, false, false, NULL FROM chunks""",
    "model_lookup": f"""
WITH {MODELS}, {REQUESTS}
SELECT doc_id, model_name, coalesce(model_id, model_name) AS model_id, coalesce(max_length, 512) AS max_length, dimension,
  coalesce(language, 'unknown') AS language, coalesce(query_prefix, '') AS query_prefix, coalesce(passage_prefix, '') AS passage_prefix
FROM requests LEFT JOIN models USING (model_name)""",
    "model_usage": f"""
WITH {MODELS}, {REQUESTS}
SELECT model_name, count(*) AS n_docs, any_value(dimension) AS dimension, any_value(max_length) AS max_seq_length,
  any_value(language) AS language, any_value(pos = 1) AS is_default
FROM requests LEFT JOIN models USING (model_name) GROUP BY model_name""",
    "prefix_text": f"WITH {MODELS}, {REQUESTS}, {INPUTS} SELECT doc_id, t AS input_text FROM inputs",
    "truncate_text": f"WITH {MODELS}, {REQUESTS}, {INPUTS} SELECT doc_id, input_text, truncated FROM cut_inputs",
    "truncation_totals": f"""
WITH {MODELS}, {REQUESTS}, {INPUTS}
SELECT model_name, count(*) FILTER (truncated) AS n_truncated, count(*) AS n_texts FROM cut_inputs GROUP BY model_name""",
    "l2_normalize": """
WITH scaled AS (SELECT vec_id, list_transform(embedding, lambda x: (x * (vec_id % 5)::FLOAT)::FLOAT) AS v FROM embeddings),
norms AS (SELECT *, sqrt(list_reduce(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE), lambda a, b: a + b)) AS n FROM scaled)
SELECT vec_id, list_transform(v, lambda x: (x::DOUBLE / CASE WHEN n = 0 THEN 1 ELSE n END)::FLOAT) AS unit FROM norms""",
    "hash_embed": pack(256, 32) + f""",
tokens AS (
  SELECT doc_id, chunk_index, unnest({words("'passage: ' || text")}[1:512]) AS w FROM chunks),
slots AS (
  SELECT doc_id, chunk_index, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS slot, count(*)::DOUBLE AS n FROM tokens GROUP BY ALL),
vectors AS (
  SELECT doc_id, chunk_index, sqrt(sum(n * n)) AS norm, map_from_entries(list(row(slot, n))) AS m FROM slots GROUP BY doc_id, chunk_index)
SELECT doc_id, chunk_index, 'e5-base-v2' AS embedding_model_id,
  list_transform(range(64), lambda i: (coalesce(m[i], 0) / norm)::FLOAT) AS embedding FROM vectors""",
    "chunk_for_model": pack(512, 100) + f"""
SELECT doc_id, chunk_index, token_count, {word_count("'passage: ' || text")} > 512 AS truncated,
  CASE WHEN {word_count("'passage: ' || text")} > 512 THEN array_to_string({words("'passage: ' || text")}[1:512], ' ')
       ELSE 'passage: ' || text END AS input_text FROM chunks""",
    "quarantine": f"WITH {FILES} SELECT * FROM bad",
    "route_files": f"""
WITH {FILES} SELECT doc_id, file_ext, CASE WHEN file_ext IN ('.txt', '.docx', '.pdf') THEN 'text' END AS branch FROM files""",
    "file_results": ALL_CHUNKS + """
SELECT container_file AS filename, source_file AS member, 0 AS part, count(chunk_index)::INTEGER AS n_chunks,
  coalesce(list(chunks.text ORDER BY chunk_index) FILTER (WHERE chunk_index IS NOT NULL), []) AS texts,
  coalesce(list(token_count ORDER BY chunk_index) FILTER (WHERE chunk_index IS NOT NULL), []) AS token_counts,
  coalesce(list(source_file ORDER BY chunk_index) FILTER (WHERE chunk_index IS NOT NULL), []) AS source_files,
  coalesce(list(chunk_index ORDER BY chunk_index) FILTER (WHERE chunk_index IS NOT NULL), []) AS chunk_indexes,
  coalesce(list(true ORDER BY chunk_index) FILTER (WHERE chunk_index IS NOT NULL), []) AS sentence_aware,
  coalesce(list(false ORDER BY chunk_index) FILTER (WHERE chunk_index IS NOT NULL), []) AS is_tabular
FROM files LEFT JOIN chunks USING (doc_id) GROUP BY container_file, source_file""",
    "results_with_errors": RESULT_CHUNKS + """
SELECT source_file AS filename, count(*)::INTEGER AS n_chunks, NULL::VARCHAR AS error_code FROM chunks JOIN files USING (doc_id) GROUP BY source_file
UNION ALL SELECT source_file, 0, error_code FROM bad""",
    "totals": RESULT_CHUNKS + """
SELECT source_file AS filename, count(*) AS total_chunks, sum(token_count)::BIGINT AS total_tokens
FROM chunks JOIN files USING (doc_id) GROUP BY source_file
UNION ALL SELECT source_file, 0, 0 FROM bad""",
    "container_totals": ALL_CHUNKS + """
SELECT container_file AS filename, count(chunk_index) AS total_chunks, coalesce(sum(token_count), 0)::BIGINT AS total_tokens
FROM files LEFT JOIN chunks USING (doc_id) GROUP BY container_file""",
    "member_totals": ALL_CHUNKS + """
SELECT source_file AS filename, count(chunk_index) AS total_chunks, coalesce(sum(token_count), 0)::BIGINT AS total_tokens
FROM files LEFT JOIN chunks USING (doc_id) GROUP BY source_file""",
    "grand_total": ALL_CHUNKS + "SELECT count(*) AS total_chunks, sum(token_count)::BIGINT AS total_tokens FROM chunks",
    "npy_export": MATRICES + "SELECT filename, 0 AS part, n_chunks, npy FROM matrices",
    "base64_export": MATRICES + "SELECT filename, 0 AS part, n_chunks, to_base64(unhex(npy)) AS embeddings_base64_npy FROM matrices",
    "written_results": MATRICES + f""", {FILES}
SELECT filename, n_chunks, texts, to_base64(unhex(npy)) AS embeddings_base64_npy, NULL::VARCHAR AS error_code FROM matrices
UNION ALL SELECT source_file, 0, NULL, NULL, error_code FROM bad""",
    "decode_text": r"""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text
  ELSE translate(regexp_replace(text, '[^\x00-\x{ff}]', '?', 'g'), 'ÐÝÞðýþ', 'ĞİŞğış') END AS text FROM documents""",
    "archive_members": """
SELECT 'pack-' || doc_id // 64 || '.zip' AS container_file, 'in/doc-' || doc_id || '.txt' AS member, text FROM documents WHERE doc_id % 9 <> 4""",
    "empty_tables": """
SELECT 'region-' || n_regionkey || '.csv' AS source_file, count(*) AS n_chunks, list_sort(list(n_nationkey || ' | ' || n_name)) AS texts
FROM nation WHERE n_regionkey % 2 = 0 GROUP BY n_regionkey""",
    "empty_embedding": """
SELECT doc_id, 0 AS chunk_index, 'e5-base-v2' AS embedding_model_id, []::FLOAT[] AS embedding FROM documents WHERE false""",
    "rejected_options": """
WITH asked AS (
  SELECT 'part-' || p_partkey AS source_file, p_size - 3 AS m, p_partkey % 40 AS o, p_partkey % 13 - 1 AS v, p_partkey % 7 = 0 AS odd FROM part)
SELECT source_file, 'INVALID_PARAMETER' AS error_code, NULL::VARCHAR AS detail,
  CASE WHEN odd THEN 'normalization must be one of none, lowercase, uppercase, got ' || chr(39) || 'titlecase' || chr(39)
       WHEN m < 1 THEN 'max_tokens must be an integer between 1 and 32768, got ' || m
       WHEN v < 0 OR v > 10 THEN 'values_only_threshold must be an integer between 0 and 10, got ' || v
       ELSE 'overlap must be below max_tokens' END AS message
FROM asked WHERE odd OR m < 1 OR v < 0 OR v > 10 OR o >= m""",
    "spanning_cells": """SELECT doc_id::VARCHAR AS doc_id, text, lang || ', "' || source || '"' AS origin FROM documents""",
    "delimiter_profile": """
SELECT o_orderpriority AS source_file, ([',', ';', chr(9), '|', ','])[substr(o_orderpriority, 1, 1)::INTEGER] AS sep, 3 AS n_fields,
  1.0::DOUBLE AS share FROM orders GROUP BY o_orderpriority""",
    "archive_policy": f"""
WITH {MEMBERS}
SELECT archive AS container_file, member AS source_file, lower(regexp_extract(member, '[.][^.]*$')) AS file_ext,
  ordinal::INTEGER AS ordinal, file_size
FROM manifest JOIN verdicts USING (archive)
WHERE enc = 0 AND total <= 5000000 AND NOT is_dir AND lower(regexp_extract(member, '[.][^.]*$')) IN ('.txt', '.docx', '.pdf')""",
    "archive_errors": f"""
WITH {MEMBERS}
SELECT archive AS source_file, CASE WHEN enc = 1 THEN 'ZIP_PASSWORD_REQUIRED' ELSE 'INVALID_FILE' END AS error_code,
  CASE WHEN enc = 1 THEN 'ZIP file ''' || archive || ''' is password-protected. Provide zip_password.'
       ELSE 'Cannot read file: ''' || archive || ''' - ZIP decompressed boyutu çok büyük: ' || format('{{:.0f}}', total / 1048576.0::DOUBLE)
            || 'MB (limit: 5MB)' END AS message, NULL::VARCHAR AS detail
FROM verdicts WHERE enc = 1 OR total > 5000000""",
    "page_concat": """
SELECT conv_id::VARCHAR AS doc, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE turn % 4 <> 3 AND text <> '' GROUP BY conv_id""",
    "block_dedupe": f"""
WITH {LINES},
pars AS (SELECT doc, 0 AS part, ord, text FROM blocks WHERE par AND {strip('text')} <> ''),
cells AS (SELECT doc, 1 AS part, min(ord) AS ord, {strip('text')} AS text FROM blocks WHERE NOT par AND {strip('text')} <> '' GROUP BY doc, {strip('text')}),
kept AS (SELECT * FROM pars UNION ALL SELECT c.* FROM cells c ANTI JOIN pars p ON p.doc = c.doc AND p.text = c.text)
SELECT doc, string_agg(text, chr(10) ORDER BY part, ord) AS text FROM kept GROUP BY doc""",
    "delimited_round_trip": """
SELECT p_partkey::VARCHAR AS p_partkey, p_name || '; ' || p_brand AS p_label, CASE WHEN p_size % 5 <> 0 THEN p_type END AS p_type,
  lpad(p_size::VARCHAR, 3, '0') AS p_size FROM part""",
    "incremental_ingest": pack(512, 100) + "SELECT doc_id, chunk_index, text, token_count FROM chunks",
}
