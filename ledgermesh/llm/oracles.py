"""DuckDB SQL for the queries that SQL can express on whole tables."""

from .licenses import COMMENT, MARKERS, RESERVED, SPDX, TEMPLATES, THRESHOLD, WRAPPED, names


def _sql(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _marked(column: str) -> str:
    return "(" + " OR ".join(f"contains({column}, {_sql(m)})" for m in MARKERS) + ")"


CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
    count(*) OVER (PARTITION BY conv_id) AS n,
    length(regexp_replace(role, '<(~*)\|', '<~\1|', 'g')) + length(regexp_replace(text, '<(~*)\|', '<~\1|', 'g')) + 32 AS shown
  FROM turns
), summed AS (
  SELECT *, sum(shown) OVER (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM numbered
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars,
  (count(*) FILTER (role = 'assistant'))::BIGINT AS n_examples
FROM summed GROUP BY conv_id
"""

LICENSES = f"""
WITH files AS (
  SELECT doc_id, lower(coalesce(text, '')) AS text, coalesce(source, 'unknown') AS top,
    {_marked("lower(split_part(coalesce(text, ''), chr(10), 1))")} AS whole FROM documents
), rows AS (
  SELECT doc_id, text, whole,
    concat_ws('/', top, doc_id // 4096, CASE WHEN NOT whole OR doc_id % 3 > 0 THEN doc_id // 512 END, CASE WHEN NOT whole OR doc_id % 3 = 2 THEN doc_id // 64 END) AS dir
  FROM files
), lines AS (
  SELECT doc_id, whole, dir, pos, CASE WHEN contains(line, '{SPDX}') THEN '' ELSE trim(line, ' ') END AS line FROM (
    SELECT doc_id, whole, dir, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM rows WHERE {_marked("text")})
), kinds AS (
  SELECT doc_id, whole, dir, pos, line, 'short' AS kind, regexp_matches(line, '[a-z0-9]') AND length(line) <= {WRAPPED} AS held FROM lines
  UNION ALL SELECT doc_id, whole, dir, pos, line, 'comment', regexp_matches(line, '[a-z0-9]') AND regexp_matches(line, '{COMMENT}') FROM lines
), blocks AS (
  SELECT doc_id, whole, dir, kind, run, trim(string_agg(line, ' ' ORDER BY pos), ' ') AS unit FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY doc_id, kind ORDER BY pos) AS run FROM kinds WHERE held)
  GROUP BY doc_id, whole, dir, kind, run
), units AS (
  SELECT DISTINCT doc_id, whole, dir, unit FROM (
    SELECT doc_id, whole, dir, line AS unit FROM lines
    UNION ALL SELECT doc_id, whole, dir, unit FROM blocks
    UNION ALL SELECT doc_id, whole, dir, trim(text, ' ') FROM rows WHERE whole)
  WHERE {_marked("unit")}
), declared AS (
  SELECT doc_id, whole, dir, name AS license FROM (
    SELECT doc_id, whole, dir, regexp_replace(regexp_extract(text, '{SPDX}:[ \\t]*[(]*[ \\t]*([a-z0-9.+-]+)', 1), '(-only|-or-later|[+])$', '') AS id FROM rows)
  JOIN (VALUES {", ".join(f"({_sql(k)})" for k in names(TEMPLATES) if k != RESERVED)}) t(name) ON lower(name) = id
), texts AS (
  SELECT DISTINCT NULL AS name, unit FROM units
  UNION ALL SELECT name, lower(unit) FROM (VALUES {", ".join(f"({_sql(k)}, {_sql(v)})" for k, v in sorted(TEMPLATES.items()))}) t(name, unit)
), terms AS (
  SELECT name, unit, token, count(*) AS tf FROM (
    SELECT name, unit, unnest(string_split(regexp_replace(regexp_replace(unit, '[^a-z0-9.]+', ' ', 'g'), '\\.+( |$)', ' ', 'g'), ' ')) AS token FROM texts)
  WHERE token <> '' GROUP BY ALL
), idf AS (
  SELECT token, ln((1.0 + (SELECT count(*) FROM texts)) / (1.0 + count(*))) + 1.0 AS idf FROM terms GROUP BY token
), weighted AS (
  SELECT name, unit, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY name, unit)) AS w FROM terms JOIN idf USING (token)
), scored AS (
  SELECT unit, license, score FROM (
    SELECT u.unit, regexp_replace(t.name, ' \\(.*\\)$', '') AS license, round(sum(u.w * t.w), 6) AS score
    FROM weighted u JOIN weighted t USING (token) WHERE u.name IS NULL AND t.name IS NOT NULL GROUP BY u.unit, t.name)
  QUALIFY row_number() OVER (PARTITION BY unit ORDER BY score DESC, license) = 1
), own AS (
  SELECT * FROM (
    SELECT doc_id, whole, dir, license, score, CASE WHEN license = '{RESERVED}' THEN 2 ELSE 1 END AS kind FROM units JOIN scored USING (unit) WHERE score >= {THRESHOLD}
    UNION ALL SELECT doc_id, whole, dir, license, 1.0, 0 FROM declared)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY kind, score DESC, license) = 1
), granted AS (
  SELECT dir AS holder, license FROM own WHERE whole QUALIFY row_number() OVER (PARTITION BY dir ORDER BY kind, score DESC, license) = 1
), nearest AS (
  SELECT d.dir, g.holder, g.license FROM (SELECT DISTINCT dir FROM rows) d JOIN granted g ON d.dir = g.holder OR starts_with(d.dir, g.holder || '/')
  QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(g.holder) DESC) = 1
)
SELECT r.doc_id, o.license AS own_license, o.score AS own_score, coalesce(o.license, n.license) AS license,
  CASE WHEN o.license IS NOT NULL THEN 'header' WHEN n.dir IS NOT NULL THEN 'dir:' || n.holder END AS license_from
FROM rows r LEFT JOIN own o USING (doc_id) LEFT JOIN nearest n ON n.dir = r.dir
"""

ORACLE_SQL = {"op4_chat_format": CHAT, "op9_licenses": LICENSES}
