"""Queries on the integrity of links: hierarchies (problem 3) and references without a match (problem 6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomstore.operators import hierarchy as H
from loomstore.operators import orphans as O
from loomstore.sources.tables import read_table


def _links(spark: SparkSession, d: str) -> DataFrame:
    return H.containment_links(read_table(spark, d, "relations"), read_table(spark, d, "memories"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return H.hierarchy(_links(spark, d))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    """Each node's path from its root, as one string."""
    t = H.hierarchy(_links(spark, d), with_path=True)
    return t.selectExpr("node_id", "root_id", "node_depth", "array_join(path, '/') AS node_path")


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return H.descendants(H.hierarchy(_links(spark, d), with_path=True))


def p3_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    return H.descendant_counts(H.hierarchy(_links(spark, d), with_path=True))


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_references(read_table(spark, d, "relations"), read_table(spark, d, "memories"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("relation_id", "ref_field")


def p6_counts(spark: SparkSession, d: str) -> DataFrame:
    return O.orphan_counts(_orphans(spark, d))


_TREE = """
WITH RECURSIVE told AS (
  SELECT DISTINCT lower(trim(source_id)) AS s, lower(trim(target_id)) AS t, replace(lower(trim(link_type)), '-', '_') AS l
  FROM relations WHERE source_id IS NOT NULL AND target_id IS NOT NULL
), ids AS (SELECT DISTINCT lower(trim(id)) AS id FROM memories),
links AS (
  SELECT child, min(parent) AS parent FROM (
    SELECT CASE WHEN l = 'contains' THEN t ELSE s END AS child, CASE WHEN l = 'contains' THEN s ELSE t END AS parent
    FROM told WHERE l IN ('contains', 'contained_by') AND s IN (SELECT id FROM ids) AND t IN (SELECT id FROM ids))
  GROUP BY child
), nodes AS (SELECT child AS node FROM links UNION SELECT parent FROM links),
walk AS (
  SELECT node, node AS root, 0 AS depth, [node] AS path FROM nodes WHERE node NOT IN (SELECT child FROM links)
  UNION ALL
  SELECT l.child, w.root, w.depth + 1, list_append(w.path, l.child) FROM walk w JOIN links l ON l.parent = w.node
)
"""

_REFS = """
WITH refs AS (
  SELECT DISTINCT lower(id) AS relation_id, f AS ref_field, created_at,
    CASE f WHEN 'source_id' THEN lower(source_id) WHEN 'target_id' THEN lower(target_id) ELSE lower(trim(target_name)) END AS k
  FROM relations, (VALUES ('source_id'), ('target_id'), ('target_name')) v(f)
  WHERE f = 'source_id' OR (f = 'target_id' AND target_id IS NOT NULL) OR (f = 'target_name' AND target_id IS NULL AND target_name IS NOT NULL)
), live AS (
  SELECT lower(id) AS id, created_at,
    CASE WHEN json_valid(metadata) THEN lower(trim(json_extract_string(CASE WHEN json_valid(metadata) THEN metadata ELSE '{}' END, '$.entity_name'))) END AS n
  FROM memories WHERE NOT coalesce(is_archived, false)
), parents AS (
  SELECT id AS k, false AS named, min(created_at) AS since FROM live GROUP BY id
  UNION ALL SELECT n, true, min(created_at) FROM live WHERE n IS NOT NULL GROUP BY n
), orphans AS (
  SELECT r.relation_id, r.ref_field, r.created_at FROM refs r
  LEFT JOIN parents p ON p.k = r.k AND p.named = (r.ref_field = 'target_name')
  WHERE NOT coalesce(p.since <= r.created_at, false)
)
"""

QUERIES = {
    "p3_found": p3_found,
    "p3_paths": p3_paths,
    "p3_descendants": p3_descendants,
    "p3_descendant_counts": p3_descendant_counts,
    "p6_found": p6_found,
    "p6_counts": p6_counts,
}

SQL = {
    "p3_found": _TREE
    + """SELECT n.node AS node_id, coalesce(w.root, '') AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS node_depth
FROM nodes n LEFT JOIN walk w ON w.node = n.node""",
    "p3_paths": _TREE
    + """SELECT n.node AS node_id, coalesce(w.root, '') AS root_id, CAST(coalesce(w.depth, -1) AS INTEGER) AS node_depth,
  coalesce(array_to_string(w.path, '/'), '') AS node_path FROM nodes n LEFT JOIN walk w ON w.node = n.node""",
    "p3_descendants": _TREE
    + """SELECT a.ancestor_id, a.node_id, CAST(a.depth + 1 - a.at AS INTEGER) AS distance FROM (
  SELECT node AS node_id, depth, unnest(path) AS ancestor_id, unnest(range(1, len(path) + 1)) AS at FROM walk) a WHERE a.at <= a.depth""",
    "p3_descendant_counts": _TREE
    + """SELECT n.node AS node_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_descendants FROM nodes n LEFT JOIN (
  SELECT ancestor_id, count(*) AS n FROM (SELECT unnest(path[1:-2]) AS ancestor_id FROM walk) GROUP BY ancestor_id) c ON c.ancestor_id = n.node""",
    "p6_found": _REFS + "SELECT relation_id, ref_field FROM orphans",
    "p6_counts": _REFS
    + "SELECT 'relations' AS table_name, ref_field, strftime(created_at, '%Y-%m') AS month, count(*) AS n_orphans FROM orphans GROUP BY ALL",
}
