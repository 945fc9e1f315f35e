"""SQL of the general record queries, for DuckDB."""

from __future__ import annotations

_PAGE = """lower(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://)?[^/]*')) || substr(b, length(regexp_extract(b, '^([A-Za-z][A-Za-z0-9+.-]*://)?[^/]*')) + 1)"""

P1_FOUND = r"""
WITH e AS (SELECT DISTINCT * FROM e2e_rows)
SELECT DISTINCT run_id, id, child, CAST(pos AS INTEGER) AS pos FROM (
  SELECT run_id, id, 'chunk' AS child, unnest(range(1, len(chunks) + 1)) AS pos, unnest(chunks) IS NOT NULL AS ok FROM e
  UNION ALL
  SELECT run_id, id, 'quote_rank', unnest(range(1, len(quote_ranks) + 1)), TRUE FROM e
  UNION ALL
  SELECT run_id, id, 'unsupported_claim', unnest(range(1, len(unsupported_claims) + 1)),
         NOT regexp_matches(coalesce(unnest(unsupported_claims), ''), '^[\s\p{Z}\p{C}]*$') FROM e
) WHERE ok
"""

P1_RESULTS = r"""
SELECT DISTINCT run_id, id, '' AS node_id, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS INTEGER) AS pos, category, question, answer, url_retrieved, quote_retrieved, url_rank,
       quote_retrieved_fixed, verdict, reason, grounded, failure_type FROM e2e_rows
"""

P1_ERRORS = r"""
WITH e AS (SELECT DISTINCT run_id, id, error FROM e2e_rows)
SELECT run_id, id, 'error' AS node_id, '' AS parent_id, CAST(NULL AS INTEGER) AS pos, error.stage AS stage, error.message AS message, error.trace AS trace FROM e WHERE error IS NOT NULL
"""

P1_CHUNKS = r"""
WITH e AS (SELECT DISTINCT run_id, id, chunks FROM e2e_rows),
x AS (SELECT run_id, id, unnest(range(1, len(chunks) + 1)) AS pos, unnest(chunks) AS c FROM e)
SELECT run_id, id, 'chunks/' || pos AS node_id, 'chunks' AS parent_id, CAST(pos AS INTEGER) AS pos, c.rank AS rank, c.url AS url, c.score AS score, c.text AS text FROM x WHERE c IS NOT NULL
"""

P1_QUOTE_RANKS = r"""
WITH e AS (SELECT DISTINCT run_id, id, quote_ranks FROM e2e_rows)
SELECT run_id, id, 'quote_ranks/' || pos AS node_id, 'quote_ranks' AS parent_id, CAST(pos AS INTEGER) AS pos, value FROM
  (SELECT run_id, id, unnest(range(1, len(quote_ranks) + 1)) AS pos, unnest(quote_ranks) AS value FROM e)
"""

P1_QUOTE_RANKS_FIXED = P1_QUOTE_RANKS.replace("quote_ranks", "quote_ranks_fixed")

P1_CLAIMS = r"""
WITH e AS (SELECT DISTINCT run_id, id, unsupported_claims FROM e2e_rows)
SELECT run_id, id, 'unsupported_claims/' || pos AS node_id, 'unsupported_claims' AS parent_id, CAST(pos AS INTEGER) AS pos, value FROM
  (SELECT run_id, id, unnest(range(1, len(unsupported_claims) + 1)) AS pos, unnest(unsupported_claims) AS value FROM e)
"""

P3_FOUND = rf"""
WITH bare AS (
  SELECT regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '') AS b, fetched_int AS s, id, depth, n_words,
         trim(regexp_replace(coalesce(title, ''), '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')) AS t,
         trim(regexp_replace(coalesce(heading, ''), '[\s\x1c-\x1f\x{{85}}\p{{Z}}]+', ' ', 'g')) AS h
  FROM chunk_output WHERE fetched_int IS NOT NULL AND url IS NOT NULL),
pages AS (SELECT {_PAGE} AS url, s, list_sort(list(DISTINCT (id, t, h, depth, n_words))) AS rows FROM bare GROUP BY 1, 2),
steps AS (SELECT s, lead(s) OVER (ORDER BY s) AS nxt, row_number() OVER (ORDER BY s) AS no FROM (SELECT DISTINCT s FROM pages)),
a AS (SELECT url, nxt AS s, rows FROM pages JOIN steps USING (s) WHERE nxt IS NOT NULL),
b AS (SELECT url, s, rows FROM pages JOIN steps USING (s) WHERE no > 1)
SELECT coalesce(a.url, b.url) AS url, coalesce(a.s, b.s) AS fetched_int,
       CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM a FULL OUTER JOIN b ON a.url = b.url AND a.s = b.s
WHERE a.url IS NULL OR b.url IS NULL OR a.rows <> b.rows
"""

#: Fields of all lines and the renames between consecutive files.
_P5 = r"""
WITH RECURSIVE lines AS (
  SELECT ledger, file_no, line_no, CASE WHEN json_valid(raw_record) THEN CAST(raw_record AS JSON) END AS j FROM runs_raw),
files AS (SELECT DISTINCT ledger, file_no FROM lines),
objects AS (SELECT ledger, file_no, line_no, json_extract_string(j, '$.run_id') AS run, j FROM lines WHERE json_type(j) = 'OBJECT'),
walk AS (
  SELECT ledger, file_no, line_no, run, k AS path, json_extract(j, '$."' || k || '"') AS v FROM (SELECT *, unnest(json_keys(j)) AS k FROM objects)
  UNION ALL
  SELECT ledger, file_no, line_no, run, path || '.' || k, json_extract(v, '$."' || k || '"')
  FROM (SELECT *, unnest(json_keys(v)) AS k FROM walk WHERE json_type(v) = 'OBJECT')),
fl AS (
  SELECT ledger, file_no, line_no, run, path, json_type(v) AS jt,
         CASE WHEN json_type(v) IN ('VARCHAR', 'BOOLEAN', 'ARRAY') THEN CAST(v AS VARCHAR) WHEN CAST(v AS DOUBLE) = floor(CAST(v AS DOUBLE)) THEN CAST(CAST(CAST(v AS DOUBLE) AS HUGEINT) AS VARCHAR)
              ELSE CAST(CAST(v AS DOUBLE) AS VARCHAR) END AS v,
         CASE json_type(v) WHEN 'VARCHAR' THEN v ->> '$' END AS plain,
         CASE json_type(v) WHEN 'VARCHAR' THEN 's' WHEN 'BOOLEAN' THEN 'b' WHEN 'ARRAY' THEN 'a' ELSE 'n' END AS t
  FROM walk WHERE json_type(v) NOT IN ('OBJECT', 'NULL')),
f AS (SELECT DISTINCT ledger, file_no, run, path, v, t FROM fl),
heads AS (SELECT ledger, file_no, path, list_sort(list(DISTINCT t)) AS t FROM f GROUP BY ALL),
pairs AS (SELECT b.ledger, b.file_no FROM files a JOIN files b ON a.ledger = b.ledger AND a.file_no + 1 = b.file_no),
prev AS (SELECT h.ledger, h.file_no + 1 AS file_no, path, t FROM heads h JOIN pairs p ON p.ledger = h.ledger AND p.file_no = h.file_no + 1),
cur AS (SELECT h.* FROM heads h JOIN pairs p ON p.ledger = h.ledger AND p.file_no = h.file_no),
gone AS (SELECT * FROM prev ANTI JOIN cur USING (ledger, file_no, path)),
new AS (SELECT * FROM cur ANTI JOIN prev USING (ledger, file_no, path)),
runs AS (SELECT DISTINCT b.ledger, b.file_no, b.run FROM f a JOIN f b ON a.ledger = b.ledger AND a.file_no + 1 = b.file_no AND a.run = b.run),
g AS (SELECT gone.ledger, gone.file_no, gone.path, gone.t, f.run, f.v FROM gone
      JOIN f ON f.ledger = gone.ledger AND f.file_no + 1 = gone.file_no AND f.path = gone.path SEMI JOIN runs r
      ON r.ledger = gone.ledger AND r.file_no = gone.file_no AND r.run = f.run),
n AS (SELECT new.ledger, new.file_no, new.path, new.t, f.run, f.v FROM new
      JOIN f ON f.ledger = new.ledger AND f.file_no = new.file_no AND f.path = new.path SEMI JOIN runs r
      ON r.ledger = new.ledger AND r.file_no = new.file_no AND r.run = f.run),
gs AS (SELECT ledger, file_no, path, any_value(t) AS t, list_sort(list((run, v))) AS held FROM g GROUP BY ALL),
ns AS (SELECT ledger, file_no, path, any_value(t) AS t, list_sort(list((run, v))) AS held FROM n GROUP BY ALL),
ren AS (SELECT gs.ledger, gs.file_no, gs.path AS a, ns.path AS b FROM gs JOIN ns
        ON gs.ledger = ns.ledger AND gs.file_no = ns.file_no AND gs.t = ns.t AND gs.held = ns.held)"""

P5_FOUND = _P5 + r"""
SELECT ledger, file_no, 'renamed' AS change_kind, a AS field_path, b AS new_path FROM ren
UNION ALL SELECT ledger, file_no, 'removed', path, '' FROM gone ANTI JOIN ren ON ren.ledger = gone.ledger AND ren.file_no = gone.file_no AND ren.a = gone.path
UNION ALL SELECT ledger, file_no, 'added', path, '' FROM new ANTI JOIN ren ON ren.ledger = new.ledger AND ren.file_no = new.file_no AND ren.b = new.path
UNION ALL SELECT ledger, file_no, 'retyped', path, '' FROM cur JOIN prev USING (ledger, file_no, path) WHERE cur.t <> prev.t
"""

P5_VALUES = _P5 + r""",
last AS (SELECT ledger, max(file_no) AS last FROM files GROUP BY ledger),
named AS (
  SELECT ledger, file_no, path, file_no AS at, path AS latest FROM heads
  UNION ALL SELECT m.ledger, m.file_no, m.path, m.at + 1, coalesce(ren.b, m.latest) FROM named m JOIN last ON last.ledger = m.ledger
  LEFT JOIN ren ON ren.ledger = m.ledger AND ren.file_no = m.at + 1 AND ren.a = m.latest WHERE m.at < last.last),
final AS (SELECT m.ledger, m.file_no, m.path, m.latest FROM named m JOIN last ON last.ledger = m.ledger AND m.at = last.last),
w AS (SELECT fl.*, latest, CASE WHEN jt = 'BOOLEAN' THEN 1 WHEN jt = 'DOUBLE' THEN 4 WHEN jt = 'VARCHAR' THEN 8 WHEN jt = 'ARRAY' THEN 16 ELSE 2 END AS bit FROM fl JOIN final USING (ledger, file_no, path)),
b1 AS (SELECT ledger, latest, file_no, bit_or(bit) AS bits FROM w GROUP BY ALL),
b2 AS (SELECT ledger, latest, arg_max(bits, file_no) AS bits FROM b1 GROUP BY ALL),
kinds AS (SELECT latest, bit_or(bits) AS b FROM b2 GROUP BY latest)
SELECT ledger, run AS run_id, latest AS field,
       CASE WHEN b & 16 > 0 THEN 'array' WHEN b & 8 > 0 OR (b & 1 > 0 AND b & 6 > 0) THEN 'string' WHEN b & 1 > 0 THEN 'boolean' WHEN b & 4 > 0 THEN 'double' ELSE 'bigint' END AS kind,
       file_no, coalesce(plain, v) AS value
FROM w JOIN kinds USING (latest) WHERE run IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY ledger, run, latest ORDER BY file_no DESC, line_no DESC, (path = latest) DESC) = 1
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND, "p1_results": P1_RESULTS, "p1_errors": P1_ERRORS, "p1_chunks": P1_CHUNKS, "p1_quote_ranks": P1_QUOTE_RANKS, "p1_quote_ranks_fixed": P1_QUOTE_RANKS_FIXED, "p1_claims": P1_CLAIMS, "p3_found": P3_FOUND, "p5_found": P5_FOUND, "p5_values": P5_VALUES}
