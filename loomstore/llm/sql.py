"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(lower(nfc_normalize(content)), '[\p{L}\p{N}]+')"

P1 = f"""
WITH t AS (SELECT DISTINCT 0 AS born, coalesce(namespace, 'default') AS ns, {_WORDS} AS w FROM memories WHERE content IS NOT NULL
  UNION ALL SELECT input_id, coalesce(namespace, 'default'), {_WORDS} FROM memory_inputs WHERE content IS NOT NULL),
d AS (SELECT row_number() OVER () AS k, * FROM t),
g AS (SELECT DISTINCT k, born, ns, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT k, born, ns, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
n AS (SELECT k, count(*) AS n FROM g GROUP BY k),
near AS (SELECT x.born FROM g x JOIN g y ON y.ns = x.ns AND y.a = x.a AND y.b = x.b AND y.c = x.c AND y.born < x.born JOIN n u ON u.k = x.k JOIN n v ON v.k = y.k
  WHERE x.born > 0 GROUP BY x.born, x.k, y.k, u.n, v.n HAVING 2 * count(*) >= u.n + v.n - count(*))
SELECT born AS input_id FROM near UNION SELECT x.born FROM d x JOIN d y ON y.ns = x.ns AND y.w = x.w AND y.born < x.born
"""

P2 = """
WITH v AS (SELECT decision_id AS id, embedding::DOUBLE[] AS e FROM dedup_decisions WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
r AS (SELECT a.id AS a, b.id AS b FROM v a JOIN v b ON a.id <> b.id
  QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 6) DESC, b.id) <= 5)
SELECT DISTINCT least(a, b) AS decision_a, greatest(a, b) AS decision_b FROM r
"""

P2_LISTS = P2[: P2.index("r AS (SELECT")].rstrip().rstrip(",") + """
SELECT a.id AS decision_id, b.id AS neighbour_id, CAST(row_number() OVER w AS INTEGER) AS rank, round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 6) AS sim
FROM v a JOIN v b ON a.id <> b.id
WINDOW w AS (PARTITION BY a.id ORDER BY round(list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e)) / sqrt(list_dot_product(b.e, b.e)), 6) DESC, b.id) QUALIFY row_number() OVER w <= 5
"""

_PLAIN = r"regexp_replace(lower(nfc_normalize({0})), '[^\p{{L}}\p{{N}}]+', '', 'g')"
_KEY = r"\s*[\p{L}_][\p{L}\p{N}_]*([.-][\p{L}\p{N}_]+)*\s*:[\s\S]*"


def _parts(sign: str) -> str:
    return f"list_filter(regexp_split_to_array(t, '{sign}'), lambda x: trim(x, e' \\t\\r\\n') <> '')"


def _is_record(name: str) -> str:
    keys = "list_transform(@, lambda x: " + _PLAIN.format("split_part(x, ':', 1)") + ")"
    return f"(len({name}) >= 3 AND len(list_filter({name}, lambda x: regexp_full_match(x, '{_KEY}'))) = len({name}) AND len(list_distinct({keys.replace('@', name)})) = len({name}))"


_PAIRS = "list_sort(list_distinct(list_transform(@, lambda x: " + _PLAIN.format("split_part(x, ':', 1)") + " || '=' || " + _PLAIN.format("substr(x, strpos(x, ':') + 1)") + ")))"

GROUPS = (
    """
WITH raw AS (SELECT DISTINCT id, coalesce(namespace, 'default') AS ns, content FROM memories WHERE content IS NOT NULL),
t AS (SELECT DISTINCT content, trim(content, e' \\t\\r\\n' || chr(65279) || chr(8203) || chr(8201)) AS t FROM raw),
p AS (SELECT *, CASE WHEN t[1] = '{' AND t[-1] = '}' AND json_valid(t) THEN t END AS j, """
    + f"{_parts('[\\r\\n]+')} AS p1, {_parts('[|]')} AS p2, {_parts(';')} AS p3"
    + """ FROM t),
c AS (SELECT content, CASE
  WHEN j IS NOT NULL THEN '#' || array_to_string(list_sort(list_distinct(list_transform(json_keys(j), lambda k: """
    + _PLAIN.format("k")
    + " || '=' || "
    + _PLAIN.format("coalesce(json_extract_string(j, '/' || k), 'null')")
    + "))), '&')\n"
    + "".join(f"  WHEN {_is_record(p)} THEN '#' || array_to_string({_PAIRS.replace('@', p)}, '&')\n" for p in ("p1", "p2", "p3"))
    + "  ELSE "
    + _PLAIN.format("content")
    + """ END AS canon FROM p),
m AS (SELECT raw.id, raw.ns, c.canon FROM raw JOIN c ON c.content = raw.content),
g AS (SELECT id, min(id) OVER w AS first_id, count(*) OVER w AS n FROM (SELECT DISTINCT * FROM m) WINDOW w AS (PARTITION BY ns, canon))
"""
)

P5 = GROUPS + "SELECT first_id, id AS copy_id FROM g WHERE id <> first_id"

P5_COPIES = GROUPS + """, w AS (SELECT coalesce(namespace, 'default') AS ns, content, count(*) AS n FROM memories WHERE content IS NOT NULL GROUP BY ALL),
k AS (SELECT w.ns, c.canon, sum(w.n) AS n_rows, count(*) AS n_formats FROM w JOIN c ON c.content = w.content GROUP BY ALL)
SELECT ns, n_rows::BIGINT AS n_rows, n_formats, count(*) AS n_contents FROM k GROUP BY ALL"""

P7 = (
    GROUPS
    + """, x AS (SELECT DISTINCT g.first_id, g.id, s.updated_at, CASE WHEN s.importance BETWEEN 1 AND 5 THEN s.importance END AS importance,
  CASE WHEN json_valid(s.metadata) AND json_type(CASE WHEN json_valid(s.metadata) THEN s.metadata ELSE '{}' END) = 'OBJECT' THEN s.metadata END AS metadata FROM g JOIN (SELECT DISTINCT * FROM memories) s ON s.id = g.id WHERE g.n > 1),
k AS (SELECT first_id, id, key FROM (SELECT first_id, id, metadata, unnest(json_keys(metadata)) AS key FROM x WHERE metadata IS NOT NULL) WHERE coalesce(json_extract_string(metadata, '/' || key), '') <> ''),
h AS (SELECT id, count(*) AS n FROM k GROUP BY id), u AS (SELECT first_id, count(DISTINCT key) AS n FROM k GROUP BY first_id),
b AS (SELECT first_id, max(updated_at) AS top, max(importance) AS best FROM x GROUP BY first_id)
SELECT x.first_id, x.id AS best_id FROM x JOIN b USING (first_id) LEFT JOIN h ON h.id = x.id LEFT JOIN u ON u.first_id = x.first_id
WHERE x.updated_at = b.top AND x.importance = b.best AND x.metadata IS NOT NULL AND coalesce(h.n, 0) = coalesce(u.n, 0)
  AND (SELECT count(*) FROM x y WHERE y.first_id = x.first_id AND y.updated_at = b.top) = 1"""
)
