"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .host_quality import LEAST, MOST, REJECT, RULES, SUSPECT, SYMBOLS

_SEP = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

_OWN = "(q_{r} - t_{r} * (t_{r} / total)) / (t_{r} / total * (1 - t_{r} / total)) - (hosts - 1)"
_STRENGTH = "CASE WHEN t_{r} > 0 AND t_{r} < total AND spread > 1e-9 AND own_{r} * ({most} + 1) > spread THEN greatest({least}::DOUBLE, spread / own_{r} - 1) ELSE {most}::DOUBLE END"
_WORST = ", ".join(f"(k_{r} + t_{r} / total * s_{r}) / (n + s_{r})" for r in RULES)

OP5 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS x, lower(trim(coalesce(source, ''))) AS host FROM documents),
w AS (SELECT doc_id, host, x, list_filter(string_split(translate(x, {_SEP}, '     '), ' '), lambda s: s <> '') AS ws,
  list_filter(string_split(x, chr(10)), lambda l: translate(l, ' ' || {_SEP}, '') <> '') AS ls FROM d),
g AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM w, unnest(range(1, len(ws) - 1)) AS u(i)),
r AS (SELECT doc_id, count(DISTINCT i + j)::BIGINT AS n_repeat_words FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g), (VALUES (0), (1), (2)) AS o(j) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, host, len(ws)::BIGINT AS n_words, length(translate(x, ' ' || {_SEP}, ''))::BIGINT AS word_chars, (length(x) - length(translate(x, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS f_base, 2 * n_symbols > n_words AS f_symbols, 10 * n_dup_lines > 3 * greatest(n_lines, 1) AS f_dup_lines FROM m),
h AS (SELECT host, count(*) AS n, {', '.join(f'sum(f_{r}::INT) AS k_{r}' for r in RULES)} FROM f GROUP BY host),
p AS (SELECT count(*) AS hosts, sum(n)::DOUBLE AS total, sum(n::DOUBLE * n) AS squares, {', '.join(f'sum(k_{r})::DOUBLE AS t_{r}, sum(k_{r}::DOUBLE * k_{r} / n) AS q_{r}' for r in RULES)} FROM h),
o AS (SELECT *, total - squares / total - (hosts - 1) AS spread, {', '.join(f'CASE WHEN t_{r} > 0 AND t_{r} < total THEN {_OWN.format(r=r)} END AS own_{r}' for r in RULES)} FROM p),
s AS (SELECT h.*, o.*, {', '.join(_STRENGTH.format(r=r, least=LEAST, most=MOST) + f' AS s_{r}' for r in RULES)} FROM h, o),
v AS (SELECT host, CASE WHEN greatest({_WORST}) > {REJECT} THEN 'reject' WHEN greatest({_WORST}) > {SUSPECT} THEN 'suspect' ELSE 'pass' END AS host_verdict FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f_base AS base_failed,
  NOT f_base AND host_verdict <> 'reject' AND NOT (host_verdict = 'suspect' AND (f_symbols OR f_dup_lines)) AS kept, host_verdict FROM f JOIN v USING (host)"""

_COMPONENTS = """, both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT a AS node, b AS other FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON x.a = r.other),
c AS (SELECT node, min(other) AS low FROM reach GROUP BY node)"""

OP8 = f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split(translate(coalesce(text, ''), {_SEP} || 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '     abcdefghijklmnopqrstuvwxyz'), ' '), lambda s: s <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS g FROM d, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS u(i) WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * k >= 85 * (p.n + q.n - k)){_COMPONENTS}
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low, d.doc_id)) AS component_id FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id"""

OP9 = f"""WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
g AS (SELECT * FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_sum(list_transform(x, lambda y: y * y)) > 0),
e AS (SELECT p.vec_id AS a, q.vec_id AS b FROM g p JOIN g q ON p.vec_id < q.vec_id AND list_cosine_similarity(p.x, q.x) >= 0.95){_COMPONENTS},
l AS (SELECT a, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(low, vec_id)) AS kept FROM v LEFT JOIN l ON l.a = vec_id LEFT JOIN c ON c.node = vec_id"""
