"""SQL of the text problems, for DuckDB."""

from __future__ import annotations

P2_FOUND = r"""
WITH c AS (SELECT DISTINCT id, text FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM c),
s AS (SELECT DISTINCT id, text, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w),
n AS (SELECT id, text, count(*) AS n FROM s GROUP BY ALL),
k AS (SELECT s.*, n.n FROM s JOIN n USING (id, text)),
p AS (SELECT a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb, count(*) AS common FROM k a JOIN k b ON a.g = b.g AND a.id < b.id
      AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.text, b.text, a.n, b.n)
SELECT DISTINCT id_a, id_b FROM p WHERE common / (na + nb - common) >= 0.6
"""

P2_GROUPS = r"""
WITH RECURSIVE c AS (SELECT DISTINCT id, text FROM chunks WHERE id IS NOT NULL AND text IS NOT NULL),
w AS (SELECT id, text, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM c),
d AS (SELECT id, list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS s FROM w),
m AS (SELECT id, md5(CAST(s AS VARCHAR)) AS cls, s FROM d WHERE len(s) > 0),
k AS (SELECT cls, len(any_value(s)) AS n, any_value(s) AS s, count(*) AS n_copies, min(id) AS least FROM m GROUP BY cls),
g AS (SELECT cls, n, unnest(s) AS g FROM k),
l AS (SELECT a.cls AS a, b.cls AS b FROM g a JOIN g b ON a.g = b.g AND a.cls <> b.cls AND least(a.n, b.n) >= 0.6 * greatest(a.n, b.n)
      GROUP BY a.cls, b.cls, a.n, b.n HAVING count(*) / (a.n + b.n - count(*)) >= 0.6),
r AS (SELECT a AS cls, b AS other FROM l UNION SELECT r.cls, l.b FROM r JOIN l ON l.a = r.other),
f AS (SELECT k.cls, least(k.least, min(o.least)) AS group_id FROM k LEFT JOIN r ON r.cls = k.cls LEFT JOIN k o ON o.cls = r.other GROUP BY k.cls, k.least)
SELECT m.id, group_id, n_copies, (SELECT count(*) FROM l WHERE l.a = m.cls) AS n_links FROM m JOIN k USING (cls) JOIN f USING (cls)
"""


P6_FOUND = r"""
WITH c AS (SELECT DISTINCT id, lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS site, text FROM chunks
           WHERE text IS NOT NULL AND id IS NOT NULL AND regexp_matches(text, '[^\s\p{Z}]')),
n AS (SELECT site, count(*) AS n FROM c GROUP BY site),
l AS (SELECT id, site, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM c),
k AS (SELECT id, site, text, line_no,
      trim(regexp_replace(regexp_replace(lower(line), '\p{Nd}+', '0', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) AS line FROM l),
e AS (SELECT site, line FROM k JOIN n USING (site) WHERE line <> '' GROUP BY site, line, n HAVING count(DISTINCT (id, text)) >= greatest(8, 0.05 * n))
SELECT DISTINCT id, CAST(line_no AS INTEGER) AS line_no FROM k SEMI JOIN e USING (site, line)
"""

P6_CLEAN = rf"""
WITH gone AS ({P6_FOUND}), t AS (SELECT DISTINCT id, text FROM chunks),
n AS (SELECT id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS line FROM t WHERE text IS NOT NULL),
k AS (SELECT n.id, n.text, string_agg(line, chr(10) ORDER BY n.line_no) FILTER (gone.id IS NULL) AS kept FROM n LEFT JOIN gone ON gone.id = n.id AND gone.line_no = n.line_no GROUP BY n.id, n.text)
SELECT id, coalesce(kept, '') AS text FROM k UNION ALL SELECT id, text FROM t WHERE text IS NULL
"""

#: Rounds: sources above their cap are clamped, what is left goes to the others by weight, until none is above.
P8_GOALS = r"""
WITH RECURSIVE d AS (SELECT doc_id, lower(regexp_replace(source, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')) AS source, max(strlen(text)) AS size FROM documents WHERE strlen(text) > 0 GROUP BY ALL),
s AS (SELECT t.source, t.target_share AS w, t.max_repeats AS r, CAST(coalesce(sum(d.size), 0) AS BIGINT) AS size FROM mix_targets t LEFT JOIN d ON d.source = t.source GROUP BY ALL),
c AS (SELECT *, CAST(size * r AS DOUBLE) AS cap FROM s),
t AS (SELECT least(sum(size) FILTER (cap > 0), sum(cap)) AS total FROM c),
f AS (SELECT 0 AS step, source, FALSE AS clamped FROM c WHERE cap > 0 AND w > 0
      UNION ALL
      SELECT step + 1, source, clamped OR w * lv >= cap FROM (
        SELECT f.step, c.source, f.clamped, c.w, c.cap, (t.total - coalesce(sum(c.cap) FILTER (f.clamped) OVER (PARTITION BY f.step), 0)) / nullif(sum(c.w) FILTER (NOT f.clamped) OVER (PARTITION BY f.step), 0) AS lv
        FROM f JOIN c USING (source), t WHERE f.step < 60)),
e AS (SELECT source, clamped FROM f WHERE step = 60),
l AS (SELECT (t.total - coalesce(sum(c.cap) FILTER (e.clamped), 0)) / nullif(sum(c.w) FILTER (NOT e.clamped), 0) AS lv FROM e JOIN c USING (source), t GROUP BY t.total)
SELECT c.source, c.size, round(CASE WHEN e.source IS NULL THEN 0 WHEN e.clamped THEN c.cap ELSE c.w * l.lv END, 3) AS goal, coalesce(e.clamped, FALSE) AS clamped FROM c LEFT JOIN e USING (source), l
"""


def oracle_sql() -> dict[str, str]:
    return {"p2_found": P2_FOUND, "p2_groups": P2_GROUPS, "p6_found": P6_FOUND, "p6_clean": P6_CLEAN, "p8_goals": P8_GOALS}
