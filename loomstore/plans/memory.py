"""Queries on memories and the graph of relations, each with the SQL that says the same."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstore.functions import columns as C
from loomstore.operators import graph, links, reads, writes
from loomstore.schema import LINK_TYPES
from loomstore.sources.tables import read_table

NOW = datetime(2026, 6, 1)
USER, NS = "agent-orchestrator", "code_knowledge"
QUERIES: dict = {}
SQL: dict = {}

#: Memories once per id, relations once per id in one spelling.
BASE = """
WITH RECURSIVE m AS (SELECT DISTINCT * FROM memories),
a AS (SELECT * FROM m WHERE NOT coalesce(is_archived, false)),
r AS (SELECT DISTINCT lower(id) AS id, lower(source_id) AS source_id, lower(target_id) AS target_id, target_name,
  replace(lower(trim(link_type)), '-', '_') AS link_type, description, weight, metadata, created_at FROM relations),
linked AS (SELECT source_id AS id FROM r UNION SELECT target_id FROM r WHERE target_id IS NOT NULL),
hub AS (SELECT min(source_id) AS id FROM (SELECT source_id, count(*) AS n FROM r GROUP BY 1 QUALIFY n = max(n) OVER ()))
"""
_IMPORTANCE = "CASE WHEN importance IS NULL OR importance = 0 THEN 3 ELSE importance END AS importance"
_COLUMNS = f"id, user_id, content, metadata, namespace, {_IMPORTANCE}, created_at, updated_at, content_hash"
#: A JSON object as one text of its keys in order, each with its value's JSON (as ``columns.json_pairs``).
_PAIRS = "array_to_string(list_sort(list_transform(json_keys({0}), lambda k: k || '=' || json_extract({0}, '$.\"' || k || '\"')::VARCHAR)), '&')"
_SAFE = "CASE WHEN json_valid(metadata) THEN metadata ELSE '{}' END"


def query(sql: str | None = None, base: str = BASE):
    """Registers a function under its name, with the SQL after ``base``."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = base + sql
        return f

    return add


def memories(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "memories")


def relations(spark: SparkSession, d: str) -> DataFrame:
    return reads.clean_relations(read_table(spark, d, "relations"))


def hub(spark: SparkSession, d: str) -> str:
    """The node with most outgoing relations (ties: smaller id), as a start for graph queries."""
    by = relations(spark, d).groupBy("source_id").count()
    row = by.orderBy(F.desc("count"), "source_id").first()
    return row[0] if row else ""


# reads


@query(f"SELECT {_COLUMNS} FROM m WHERE id = (SELECT min(id) FROM m)")
def memory_get(spark, d):
    first = memories(spark, d).agg(F.min("id")).first()[0]
    return reads.get(memories(spark, d), first)


@query(f"SELECT {_COLUMNS} FROM m WHERE namespace = '{NS}' AND content_hash = (SELECT min(content_hash) FROM m WHERE namespace = '{NS}')")
def memory_by_hash(spark, d):
    h = memories(spark, d).where(F.col("namespace") == NS).agg(F.min("content_hash")).first()[0]
    return reads.by_hash(memories(spark, d), NS, h)


_NAME = f"json_extract_string({_SAFE}, '$.entity_name')"


@query(f"SELECT {_COLUMNS} FROM m WHERE {_NAME} = (SELECT min({_NAME}) FROM m) ORDER BY created_at, id LIMIT 1")
def memory_by_entity_name(spark, d):
    name = memories(spark, d).agg(F.min(C.json_text(F.col("metadata"), "entity_name"))).first()[0]
    return reads.by_entity_name(memories(spark, d), name)


@query(f"SELECT {_COLUMNS} FROM a WHERE id IN (SELECT source_id FROM r WHERE link_type = 'references')")
def memory_fetch_by_ids(spark, d):
    ids = relations(spark, d).where("link_type = 'references'").select(F.col("source_id").alias("id"))
    return reads.fetch(memories(spark, d), ids)


@query(f"SELECT {_COLUMNS} FROM a WHERE user_id = '{USER}' ORDER BY created_at DESC, id LIMIT 50 OFFSET 10")
def memory_list(spark, d):
    return reads.listing(memories(spark, d), user_id=USER, limit=50, offset=10)


@query(f"SELECT {_COLUMNS}, count(*) OVER () AS total_count FROM a WHERE namespace = '{NS}' ORDER BY created_at DESC, id LIMIT 50")
def memory_list_with_count(spark, d):
    return reads.listing_with_count(memories(spark, d), namespace=NS)


@query(f"SELECT count(*) AS n FROM m WHERE namespace = '{NS}'")
def memory_count(spark, d):
    return reads.count(memories(spark, d), namespace=NS)


@query(f"SELECT {_COLUMNS} FROM a WHERE namespace = '{NS}' AND created_at >= TIMESTAMP '2025-06-01' ORDER BY created_at DESC, id LIMIT 20")
def memory_recent(spark, d):
    return reads.recent(memories(spark, d), NS, datetime(2025, 6, 1))


@query("SELECT namespace, count(*) AS n, max(updated_at) AS last_updated FROM a GROUP BY namespace")
def memory_stats(spark, d):
    return reads.stats(memories(spark, d))


@query("SELECT DISTINCT uid, name, coalesce(description, '') AS description FROM memory_namespaces", "")
def namespaces_list(spark, d):
    return reads.namespaces(read_table(spark, d, "memory_namespaces"))


@query("SELECT * FROM r WHERE source_id = (SELECT id FROM hub)")
def relations_by_source(spark, d):
    return reads.relations_by_source(read_table(spark, d, "relations"), hub(spark, d))


@query("SELECT * FROM r WHERE target_id = (SELECT min(target_id) FROM r WHERE link_type = 'contains') AND link_type = 'contains'")
def relations_by_target(spark, d):
    t = relations(spark, d).where("link_type = 'contains'").agg(F.min("target_id")).first()[0]
    return reads.relations_by_target(read_table(spark, d, "relations"), t, "contains")


@query("SELECT * FROM r WHERE source_id = (SELECT id FROM hub) AND target_id = (SELECT min(target_id) FROM r WHERE source_id = (SELECT id FROM hub))")
def relations_between(spark, d):
    start = hub(spark, d)
    t = relations(spark, d).where(F.col("source_id") == start).agg(F.min("target_id")).first()[0]
    return reads.relations_between(read_table(spark, d, "relations"), start, t)


@query("SELECT *, 'outgoing' AS direction FROM r WHERE source_id = (SELECT id FROM hub) UNION ALL SELECT *, 'incoming' FROM r WHERE target_id = (SELECT id FROM hub)")
def relations_unified(spark, d):
    return reads.relations_unified(read_table(spark, d, "relations"), hub(spark, d))


# Metadata given as text, defaults


@query(f"SELECT id, CASE WHEN json_valid(metadata) AND json_type({_SAFE}) = 'OBJECT' THEN metadata END AS metadata, CASE WHEN importance IS NULL OR importance = 0 THEN 3 ELSE importance END AS importance FROM m")
def metadata_coerce(spark, d):
    return reads.once(memories(spark, d)).select("id", C.as_metadata(F.col("metadata")).alias("metadata"), C.importance_or_default(F.col("importance")).cast("int").alias("importance"))


# graph


@query("SELECT id FROM linked")
def graph_linked_ids(spark, d):
    return graph.linked_ids(relations(spark, d))


@query("SELECT id, namespace FROM a WHERE id NOT IN (SELECT id FROM linked)")
def graph_orphans(spark, d):
    return graph.orphans(memories(spark, d), relations(spark, d))


@query("SELECT (SELECT count(*) FROM a) AS total_granules, (SELECT count(*) FROM r) AS total_relations, (SELECT count(*) FROM linked) AS linked_granules, (SELECT count(*) FROM a WHERE id NOT IN (SELECT id FROM linked)) AS orphans")
def graph_stats_cte(spark, d):
    return graph.stats_cte(memories(spark, d), relations(spark, d))


@query(
    """, n AS (SELECT (SELECT count(*) FROM a) AS g, (SELECT count(*) FROM r) AS e, (SELECT count(*) FROM a WHERE id IN (SELECT id FROM linked)) AS l)
SELECT g AS total_granules, e AS total_relations, l AS linked_granules, g - l AS orphans, CASE WHEN g > 0 THEN round(2.0::DOUBLE * e / g, 2) ELSE 0.0 END AS avg_connections FROM n"""
)
def graph_stats_unified(spark, d):
    return graph.stats_unified(memories(spark, d), relations(spark, d))


@query("SELECT namespace, count(*) AS total, count(*) FILTER (id IN (SELECT id FROM linked)) AS linked, count(*) FILTER (id NOT IN (SELECT id FROM linked)) AS orphans FROM a GROUP BY namespace")
def graph_stats_by_namespace(spark, d):
    return graph.stats_by_namespace(memories(spark, d), relations(spark, d))


@query("SELECT link_type, count(*) AS cnt FROM r GROUP BY link_type")
def graph_stats_by_link_type(spark, d):
    return graph.stats_by_link_type(relations(spark, d))


@query(
    """, x AS (SELECT a.id, coalesce(a.namespace, '') AS namespace, l.id IS NOT NULL AS is_linked FROM a LEFT JOIN linked l ON l.id = a.id),
n AS (SELECT namespace, count(*) AS total, count(*) FILTER (is_linked) AS linked, count(*) FILTER (NOT is_linked) AS orphans FROM x GROUP BY 1), t AS (SELECT coalesce(link_type, '') AS link_type, count(*) AS cnt FROM r GROUP BY 1)
SELECT (SELECT count(*) FROM x) AS total_granules, (SELECT count(*) FROM r) AS total_relations, (SELECT count(*) FROM x WHERE is_linked) AS linked_granules, (SELECT count(*) FROM x WHERE NOT is_linked) AS orphans,
  (SELECT CASE count(*) WHEN 0 THEN 0.0 ELSE round(2.0 * (SELECT count(*) FROM r) / count(*), 2) END FROM x)::DOUBLE AS avg_connections,
  (SELECT '{' || string_agg('"' || namespace || '":{"total":' || total || ',"linked":' || linked || ',"orphans":' || orphans || '}', ',' ORDER BY namespace) || '}' FROM n) AS by_namespace,
  (SELECT '{' || string_agg('"' || link_type || '":' || cnt, ',' ORDER BY link_type) || '}' FROM t) AS by_link_type"""
)
def graph_stats_json(spark, d):
    return graph.stats_json(memories(spark, d), relations(spark, d))


_WALK = """, walk AS (
  SELECT (SELECT id FROM hub) AS node_id, 0 AS depth, [(SELECT id FROM hub)] AS path
  UNION SELECT r.target_id, w.depth + 1, list_append(w.path, r.target_id) FROM walk w JOIN r ON r.source_id = w.node_id
  WHERE w.depth < 4 AND r.target_id IS NOT NULL AND NOT list_contains(w.path, r.target_id))
, least AS (SELECT node_id, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY node_id)
"""


@query(_WALK + "SELECT DISTINCT node_id, CAST(depth AS INTEGER) AS depth FROM walk")
def graph_traverse_cte(spark, d):
    return graph.walk(relations(spark, d), hub(spark, d), 4)


@query(_WALK + "SELECT m.id, left(m.content, 200) AS content, m.namespace, CASE WHEN importance IS NULL OR importance = 0 THEN 3 ELSE importance END AS importance, l.depth FROM least l JOIN m ON m.id = l.node_id")
def graph_traverse_nodes(spark, d):
    return graph.traverse_nodes(memories(spark, d), relations(spark, d), hub(spark, d), 4)


@query(_WALK + "SELECT id, source_id, target_id, link_type, description, weight FROM r WHERE source_id IN (SELECT node_id FROM least) AND target_id IN (SELECT node_id FROM least)")
def graph_traverse_edges(spark, d):
    return graph.traverse_edges(relations(spark, d), hub(spark, d), 4)


@query("SELECT link_type, count(*) AS cnt, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM r), 2) AS pct FROM r GROUP BY link_type")
def link_type_share(spark, d):
    return graph.link_type_share(relations(spark, d))


@query(
    """, pairs AS (SELECT DISTINCT r.id, s.namespace AS source_ns, t.namespace AS target_ns, r.link_type FROM r JOIN m s ON s.id = r.source_id JOIN m t ON t.id = r.target_id WHERE s.namespace <> t.namespace)
SELECT id, source_ns, target_ns, link_type FROM pairs WHERE link_type NOT IN ('references', 'related_to', 'informs')"""
)
def link_policy_violations(spark, d):
    ns = memories(spark, d).select("namespace").distinct()
    pairs = ns.select(F.col("namespace").alias("source_ns"), F.lit(1).alias("k")).join(ns.select(F.col("namespace").alias("target_ns"), F.lit(1).alias("k")), "k")
    allowed = pairs.select("source_ns", "target_ns", F.explode(F.array(F.lit("references"), F.lit("related_to"), F.lit("informs"))).alias("link_type"))
    return graph.policy_violations(memories(spark, d), relations(spark, d), allowed)


# links

_LINKS = f""", good AS (SELECT id, {_SAFE} AS j FROM m),
l AS (SELECT id AS source_id, unnest(json_extract(j, '$.links[*]')) AS l, unnest(range(len(json_extract(j, '$.links[*]')))) AS ord FROM good),
e AS (SELECT source_id, CAST(ord AS INTEGER) AS ord, json_extract_string(l, '$.type') AS link_type, json_extract_string(l, '$.target') AS target, json_extract_string(l, '$.description') AS description,
  CASE WHEN regexp_full_match(json_extract_string(l, '$.target'), '{C.UUID[1:-1]}') THEN json_extract_string(l, '$.target') END AS target_id FROM l),
made AS (SELECT source_id, target_id, CASE WHEN target_id IS NULL THEN target END AS target_name, link_type, description FROM e
  WHERE link_type IS NOT NULL AND (target_id IS NULL OR target_id IN (SELECT id FROM m))
  QUALIFY target_id IS NULL OR row_number() OVER (PARTITION BY source_id, target_id, link_type ORDER BY ord DESC) = 1)
"""


@query(_LINKS + "SELECT source_id, ord, link_type, target, description, target_id FROM e")
def links_explode(spark, d):
    return links.explode_links(memories(spark, d))


@query(
    _LINKS + """SELECT source_id, target_id, target_name, link_type, description, true AS is_new FROM made x
WHERE source_id IN (SELECT id FROM a) AND NOT EXISTS (SELECT 1 FROM r WHERE r.source_id = x.source_id AND r.target_id = x.target_id AND r.link_type = x.link_type)
UNION ALL SELECT source_id, target_id, target_name, link_type, description, false FROM r"""
)
def links_backfill(spark, d):
    r = relations(spark, d)
    after = links.backfill(r, memories(spark, d), NOW)
    return after.select("source_id", "target_id", "target_name", "link_type", "description", (F.col("created_at") == writes.at(NOW)).alias("is_new"))


@query(
    _LINKS + f""", own AS (SELECT id FROM m WHERE namespace = '{NS}'), kept AS (
  SELECT r.* FROM r WHERE NOT (source_id IN (SELECT id FROM own) AND coalesce(json_extract_string({_SAFE}, '$.synced_from') = 'metadata.links', false)))
SELECT source_id, target_id, target_name, link_type, description FROM made WHERE source_id IN (SELECT id FROM own)
UNION ALL SELECT k.source_id, k.target_id, k.target_name, k.link_type, k.description FROM kept k
WHERE NOT EXISTS (SELECT 1 FROM made x WHERE x.source_id IN (SELECT id FROM own) AND x.source_id = k.source_id AND x.target_id = k.target_id AND x.link_type = k.link_type)"""
)
def links_sync_batch(spark, d):
    ids = memories(spark, d).where(F.col("namespace") == NS).select("id")
    return links.sync_batch(relations(spark, d), memories(spark, d), ids, NOW).select("source_id", "target_id", "target_name", "link_type", "description")


@query(
    """, given AS (SELECT source_id, target_id, link_type, max(weight) + 1 AS weight FROM r WHERE target_id IS NOT NULL AND link_type = 'contains' GROUP BY ALL)
SELECT action, count(*) AS n, round(sum(weight), 6) AS w FROM (
  SELECT CASE WHEN g.weight IS NULL THEN 'kept' ELSE 'updated' END AS action, coalesce(g.weight, r.weight) AS weight FROM r LEFT JOIN given g USING (source_id, target_id, link_type)
  UNION ALL SELECT 'inserted', weight FROM (SELECT DISTINCT source_id, target_id, weight FROM given) x) GROUP BY action"""
)
def relation_upsert(spark, d):
    r = relations(spark, d)
    base = r.where("target_id IS NOT NULL AND link_type = 'contains'").groupBy("source_id", "target_id", "link_type").agg((F.max("weight") + 1).alias("weight"))
    rows = base.select(
        F.concat_ws(":", "source_id", "target_id").alias("id"), "source_id", "target_id", F.lit(None).cast("string").alias("target_name"), "link_type", F.lit("again").alias("description"), "weight",
        F.lit("{}").alias("metadata"), writes.at(NOW).alias("created_at"), F.lit(0).alias("ord"),
    )
    both = rows.unionByName(rows.withColumn("link_type", F.lit("new_type")))
    return links.upsert_relations(r, both).groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 6).alias("w"))


@query("SELECT * FROM r WHERE NOT coalesce(source_id = (SELECT id FROM hub) AND target_id = (SELECT min(target_id) FROM r WHERE source_id = (SELECT id FROM hub)) AND link_type = 'contains', false)")
def relation_delete(spark, d):
    start = hub(spark, d)
    t = relations(spark, d).where(F.col("source_id") == start).agg(F.min("target_id")).first()[0]
    return links.delete_relation(relations(spark, d), start, t, "contains")


@query("SELECT * FROM r WHERE source_id <> (SELECT id FROM hub)")
def relation_delete_by_source(spark, d):
    return links.delete_by_source(relations(spark, d), hub(spark, d))


@query(f"SELECT id FROM r WHERE NOT (source_id IN (SELECT id FROM m WHERE namespace = '{NS}') AND coalesce(json_extract_string({_SAFE}, '$.synced_from') = 'metadata.links', false))")
def relation_delete_synced(spark, d):
    return links.delete_synced(relations(spark, d), memories(spark, d).where(F.col("namespace") == NS).select("id")).select("id")


@query(
    f""", names AS (SELECT DISTINCT target_name AS entity FROM r WHERE target_id IS NULL AND target_name IS NOT NULL),
n AS (SELECT {_NAME} AS name, id FROM m QUALIFY row_number() OVER (PARTITION BY name ORDER BY created_at, id) = 1)
SELECT entity, coalesce(m.id, n.id) AS id FROM names LEFT JOIN m ON m.id = entity LEFT JOIN n ON n.name = entity"""
)
def entity_resolve(spark, d):
    w = relations(spark, d).where("target_id IS NULL AND target_name IS NOT NULL").select(F.col("target_name").alias("entity"))
    return links.resolve(memories(spark, d), w)


# Changes of memories


def _store(spark, d) -> DataFrame:
    return reads.once(memories(spark, d))


@query(f"SELECT id, CASE WHEN namespace = '{NS}' THEN 'changed' ELSE content END AS content, CASE WHEN namespace = '{NS}' THEN TIMESTAMP '2026-06-01' ELSE updated_at END AS updated_at FROM m")
def memory_update(spark, d):
    c = memories(spark, d).where(F.col("namespace") == NS).select("id", F.lit("changed").alias("content"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("int").alias("importance"))
    return writes.update_memories(_store(spark, d), c, NOW).select("id", "content", "updated_at")


@query(f"SELECT id, is_archived OR namespace = '{NS}' AS is_archived, CASE WHEN NOT is_archived AND namespace = '{NS}' THEN TIMESTAMP '2026-06-01' ELSE updated_at END AS updated_at FROM m")
def memory_archive(spark, d):
    return writes.archive(_store(spark, d), memories(spark, d).where(F.col("namespace") == NS).select("id"), NOW).select("id", "is_archived", "updated_at")


@query(f"SELECT id, is_archived OR user_id = '{USER}' AS is_archived, (SELECT count(*) FROM a WHERE user_id = '{USER}') AS deleted_count FROM m")
def memory_forget_soft(spark, d):
    new, n = writes.forget(_store(spark, d), USER, None, NOW)
    return new.select("id", "is_archived").crossJoin(F.broadcast(n))


@query(f"SELECT id FROM m WHERE NOT coalesce(user_id = '{USER}', false)")
def memory_forget_hard(spark, d):
    return writes.forget_hard(_store(spark, d), USER).select("id")


@query(
    f""", gone AS (SELECT id FROM m WHERE namespace = '{NS}')
SELECT 'memory' AS kind, id, NULL AS target_id FROM m WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'relation', id, CASE WHEN target_id IN (SELECT id FROM gone) THEN NULL ELSE target_id END FROM r WHERE source_id NOT IN (SELECT id FROM gone)"""
)
def memory_delete_cascade(spark, d):
    m, r = writes.delete_memories(_store(spark, d), relations(spark, d), memories(spark, d).where(F.col("namespace") == NS).select("id"))
    return m.select(F.lit("memory").alias("kind"), "id", F.lit(None).cast("string").alias("target_id")).unionByName(r.select(F.lit("relation").alias("kind"), "id", "target_id"))


def _inputs(spark, d) -> DataFrame:
    """Inputs as rows of memories, with the hash of their own content."""
    i = read_table(spark, d, "memory_inputs")
    return i.select(
        F.concat(F.lit("in-"), F.col("input_id")).alias("id"), "user_id", "content", F.coalesce("metadata", F.lit("{}")).alias("metadata"), F.coalesce("namespace", F.lit("default")).alias("namespace"), F.lit(None).cast("string").alias("namespace_id"),
        C.sha256(F.col("content")).alias("content_hash"), F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("source_location"), F.lit(1).alias("version"), F.lit(False).alias("is_archived"),
        C.importance_or_default(F.col("importance")).cast("int").alias("importance"), F.col("arrived_at").alias("created_at"), F.col("arrived_at").alias("updated_at"), F.col("input_id").alias("ord"),
    )


_INPUT = """, i AS (SELECT input_id, 'in-' || input_id AS id, user_id, content, coalesce(metadata, '{}') AS metadata, coalesce(namespace, 'default') AS namespace, sha256(content) AS content_hash,
  CASE WHEN importance IS NULL OR importance = 0 THEN 3 ELSE importance END AS importance FROM memory_inputs)
"""


@query(_INPUT + "SELECT id, namespace, content_hash FROM i WHERE (namespace, content_hash) NOT IN (SELECT (namespace, content_hash) FROM a WHERE content_hash IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY namespace, content_hash ORDER BY input_id) = 1")
def memory_insert_batch(spark, d):
    _, inserted = writes.insert_memories_ignore(_store(spark, d), _inputs(spark, d))
    return inserted.select("id", "namespace", "content_hash")


@query(
    _INPUT + """, last AS (SELECT * FROM i QUALIFY row_number() OVER (PARTITION BY namespace, content_hash ORDER BY input_id DESC) = 1),
k AS (SELECT * FROM a WHERE content_hash IS NOT NULL),
objects AS (SELECT * REPLACE (CASE WHEN json_valid(metadata) AND metadata[1] = '{' THEN metadata ELSE '{}' END AS metadata) FROM m),
own AS (SELECT o.id, unnest(json_keys(o.metadata)) AS key, o.metadata FROM objects o),
matched AS (SELECT k.id, CASE WHEN json_valid(l.metadata) THEN l.metadata ELSE '{}' END AS new FROM k JOIN last l ON k.namespace = l.namespace AND k.content_hash = l.content_hash),
merged AS (SELECT id, array_to_string(list_sort(list(key || '=' || v)), '&') AS pairs FROM (
  SELECT b.id, o.key, json_extract(o.metadata, '$."' || o.key || '"')::VARCHAR AS v FROM matched b JOIN own o ON o.id = b.id WHERE NOT list_contains(json_keys(b.new), o.key)
  UNION ALL SELECT id, key, json_extract(new, '$."' || key || '"')::VARCHAR FROM (SELECT id, new, unnest(json_keys(new)) AS key FROM matched)) GROUP BY id)
SELECT m.id, CASE WHEN l.id IS NULL THEN 'kept' ELSE 'updated' END AS action, coalesce(l.importance, m.importance, 0) AS importance, coalesce(l.content, m.content) AS content,
  CASE WHEN l.id IS NULL THEN coalesce(m.metadata, '') ELSE array_to_string(list_sort(list_transform(regexp_split_to_array(coalesce(g.pairs, ''), '[\\[\\]{},&]'), lambda x: regexp_replace(x, '(\\.[0-9]*[1-9])0+$|\\.0+$', '\\1'))), ',') END AS metadata
FROM m LEFT JOIN k ON k.id = m.id LEFT JOIN last l ON k.namespace = l.namespace AND k.content_hash = l.content_hash LEFT JOIN merged g ON g.id = m.id
UNION ALL SELECT l.id, 'inserted', l.importance, l.content, l.metadata FROM last l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.namespace = l.namespace AND k.content_hash = l.content_hash)"""
)
def memory_upsert(spark, d):
    return writes.upsert_memories(_store(spark, d), _inputs(spark, d), NOW).select("id", "action", F.coalesce("importance", F.lit(0)).alias("importance"), "content", F.coalesce(F.when(F.col("action") == "updated", F.array_join(F.array_sort(F.transform(F.split(C.json_pairs(F.col("metadata")), r"[\[\]{},&]"), lambda x: F.regexp_replace(x, r"(\.[0-9]*[1-9])0+$|\.0+$", "$1"))), ",")).otherwise(F.col("metadata")), F.lit("")).alias("metadata"))


@query("SELECT m.id, coalesce(m.namespace_id, n.id) AS namespace_id FROM m LEFT JOIN (SELECT uid, min(id) AS id FROM memory_namespaces GROUP BY uid) n ON n.uid = m.namespace")
def namespace_fk_fill(spark, d):
    return writes.fill_namespace_ids(_store(spark, d), read_table(spark, d, "memory_namespaces")).select("id", "namespace_id")


@query("SELECT uid, name, true AS is_old FROM memory_namespaces UNION ALL SELECT DISTINCT user_id, array_to_string(list_transform(string_split(replace(user_id, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' '), false FROM m WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT uid FROM memory_namespaces)")
def namespace_get_or_create(spark, d):
    n = read_table(spark, d, "memory_namespaces")
    out = writes.ensure_namespaces(n, memories(spark, d).select(F.col("user_id").alias("uid")), NOW)
    return out.select("uid", "name", (F.col("created_at") != writes.at(NOW)).alias("is_old"))


@query("SELECT namespace_id, count(*) AS n FROM m WHERE namespace_id IS NOT NULL AND namespace_id NOT IN (SELECT id FROM memory_namespaces) GROUP BY namespace_id")
def namespace_fk_check(spark, d):
    m = reads.once(memories(spark, d).where("namespace_id IS NOT NULL").select("id", "namespace_id"))
    ids = read_table(spark, d, "memory_namespaces").select(F.col("id").alias("namespace_id")).distinct()
    return m.join(ids, "namespace_id", "left_anti").groupBy("namespace_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT link_type, link_type IN ('" + "', '".join(LINK_TYPES) + "') AS is_known FROM r")
def link_type_check(spark, d):
    return relations(spark, d).select("link_type", F.col("link_type").isin(*LINK_TYPES).alias("is_known")).distinct()


@query(
    """SELECT to_json(m)->>'id' AS id, array_to_string(list_sort(list_filter(['id=' || id, 'user_id=' || user_id, 'content=' || content, 'metadata=' || metadata, 'namespace=' || namespace, 'namespace_id=' || namespace_id, 'content_hash=' || content_hash, 'source_type=' || source_type,
  'source_location=' || source_location, 'version=' || version, 'is_archived=' || is_archived, 'importance=' || importance, 'created_at=' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f'), 'updated_at=' || strftime(updated_at, '%Y-%m-%dT%H:%M:%S.%f')], lambda x: x IS NOT NULL)), chr(10)) AS fields FROM m"""
)
def memory_json(spark, d):
    """Memories as one JSON text each, read back as their fields in order."""
    j = reads.as_json(_store(spark, d)).select(F.from_json("json", "map<string,string>").alias("j"))
    return j.select(F.col("j")["id"].alias("id"), F.array_join(F.array_sort(F.transform(F.map_entries("j"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n").alias("fields"))
