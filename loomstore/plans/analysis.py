"""Queries on search, dedup decisions, vectors, hashes, the ledger, metrics and streams."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstore.functions import columns as C
from loomstore.functions.embed import embed
from loomstore.operators import dedup, hashes, ledger, metrics, reads, search, writes
from loomstore.plans.memory import BASE, NOW, NS, USER, memories, relations
from loomstore.plans.memory import _IMPORTANCE, _NAME
from loomstore.sources.tables import read_table, scratch
from loomstore.streaming import streams

QUERIES: dict = {}
SQL: dict = {}
TEXT = "the frozen snapshot of the dedup check"


def query(sql: str | None = None, base: str = BASE):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = base + sql
        return f

    return add


# Search; the vectors of memories are taken from the table of embeddings by the start of the id

def vectors(spark: SparkSession, d: str, with_archived: bool = False) -> DataFrame:
    """Memories with an embedding each (vec_id counts from 0; all embeddings take part), live ones unless told otherwise."""
    m = memories(spark, d)
    m = reads.once((m if with_archived else reads.active(m)).select("id", "user_id", "namespace", "importance"))
    e = read_table(spark, d, "embeddings")
    return m.join(e, F.conv(F.substring("id", 1, 6), 16, 10).cast("long") % max(1, e.count()) == F.col("vec_id")).select("id", "embedding", "user_id", "namespace", C.importance_or_default(F.col("importance")).alias("importance"))


def _query_vector(spark: SparkSession, d: str, n: int) -> list[float]:
    return list(read_table(spark, d, "embeddings").where(F.col("vec_id") == n).select("embedding").first()[0])


_V = f""", v AS (SELECT a.id, e.embedding::DOUBLE[] AS e, a.user_id, a.namespace, CASE WHEN importance IS NULL OR importance = 0 THEN 3 ELSE importance END AS importance
  FROM a JOIN embeddings e ON e.vec_id = CAST('0x' || substr(a.id, 1, 6) AS INTEGER) % (SELECT count(*) FROM embeddings))
"""


def _top(n: int, where: str, least: float, k: int = 10) -> str:
    return f"""SELECT id, round(s, 6) AS score FROM (SELECT id, list_cosine_similarity(e, (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = {n})) AS s FROM v WHERE {where})
WHERE s >= {least} ORDER BY score DESC, id LIMIT {k}"""


@query(_V + _top(7, "true", 0.2, 200))
def vector_search_filtered(spark, d):
    return search.top_k(vectors(spark, d), _query_vector(spark, d, 7), 200, 0.2)


@query(_V + _top(8, f"user_id = '{USER}'", 0.1))
def vector_search_of_user(spark, d):
    return search.top_k(vectors(spark, d), _query_vector(spark, d, 8), 10, 0.1, user_id=USER)


@query(_V.replace("FROM a JOIN", "FROM m a JOIN") + _top(8, f"user_id = '{USER}'", 0.1))
def vector_search_with_archived(spark, d):
    """The first form of the search: of one user, archived memories included."""
    return search.top_k(vectors(spark, d, True), _query_vector(spark, d, 8), 10, 0.1, user_id=USER)


@query(_V + _top(9, f"namespace = '{NS}' AND user_id = '{USER}'", 0.0))
def vector_search_user_namespace(spark, d):
    return search.top_k(vectors(spark, d), _query_vector(spark, d, 9), 10, 0.0, USER, NS)


@query(_V + ", h AS (" + _top(10, f"namespace = '{NS}'", 0.0, 50) + f") SELECT h.id, a.content, a.metadata, a.namespace, {_IMPORTANCE}, h.score FROM h JOIN a ON a.id = h.id")
def vector_search_hydrated(spark, d):
    return search.hydrate(search.top_k(vectors(spark, d), _query_vector(spark, d, 10), 50, 0.0, namespace=NS), memories(spark, d)).withColumn("importance", C.importance_or_default(F.col("importance")).cast("int"))


@query(
    """SELECT q.vec_id::VARCHAR AS query_id, v.vec_id::VARCHAR AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings v
WHERE q.vec_id % 50 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id::VARCHAR) <= 10""",
    "",
)
def knn_batch_topk(spark, d):
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.top_k_batch(e, e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 10)


@query()
def knn_batch_lsh(spark, d):
    e = read_table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return search.top_k_lsh(e, e.where("id % 50 = 0").withColumnRenamed("id", "query_id"), 10, 0.3)


_TEXT = f""", tok AS (SELECT id, unnest(regexp_extract_all(lower(content), '{C.WORDS}')) AS w FROM a),
b AS (SELECT id, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % {C.BUCKETS} AS b, count(*)::DOUBLE AS c FROM tok GROUP BY ALL),
q AS (SELECT CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % {C.BUCKETS} AS b, count(*)::DOUBLE AS c FROM (SELECT unnest(regexp_extract_all(lower('{TEXT}'), '{C.WORDS}')) AS w) GROUP BY ALL),
s AS (SELECT b.id, sum(b.c * q.c) / sqrt((SELECT sum(c * c) FROM q)) / sqrt(any_value(n.n)) AS s FROM b JOIN q ON q.b = b.b JOIN (SELECT id, sum(c * c) AS n FROM b GROUP BY id) n ON n.id = b.id GROUP BY b.id)
"""


@query(_TEXT + "SELECT a.id, a.content, a.namespace, round(s.s, 6) AS score FROM s JOIN a ON a.id = s.id WHERE s.s >= 0.3 ORDER BY score DESC, a.id LIMIT 10")
def memory_search(spark, d):
    """The text query of the store: embedded, compared with every live memory's text, hydrated."""
    v = embed(reads.once(reads.active(memories(spark, d)).select("id", "user_id", "namespace", "content", "importance")))
    q = list(spark.range(1).select(C.embedding(F.lit(TEXT)).cast("array<double>").alias("e")).first()[0])
    return search.hydrate(search.top_k(v, q, 10, 0.3), memories(spark, d)).select("id", "content", "namespace", "score")


@query(
    f""", w AS (SELECT *, regexp_extract_all(lower(content), '{C.WORDS}') AS w FROM a)
SELECT id, content, namespace, round(len(list_filter(w, lambda x: x IN ('graph', 'service', 'wrote')))::DOUBLE / len(w), 6) AS score FROM w
WHERE list_contains(w, 'graph') AND list_contains(w, 'service') AND list_contains(w, 'wrote') ORDER BY score DESC, id LIMIT 20"""
)
def memory_search_fts(spark, d):
    return search.full_text(memories(spark, d), "Graph service wrote", limit=20).select("id", "content", "namespace", "score")


@query(
    f""", c AS (SELECT DISTINCT content FROM a), k AS (SELECT content, 'embedding:' || sha256(content) AS key FROM c)
SELECT key, substr(key, 11, 1) < '8' AS hit FROM k"""
)
def embed_cache_join(spark, d):
    a = reads.active(memories(spark, d)).where(F.col("content").isNotNull())
    key = F.concat(F.lit("embedding:"), C.sha256(F.col("content")))
    cache = a.select(key.alias("key")).distinct().where(F.substring("key", 11, 1) < "8").select("key", F.array(F.lit(1.0).cast("float")).alias("embedding"), F.lit(datetime(2026, 6, 2)).cast("timestamp_ntz").alias("expires_at"))
    return search.embed_missing(a, cache, NOW).select("key", "hit")


@query(_V + f"SELECT id, CASE WHEN namespace = '{NS}' THEN 9 ELSE importance END AS importance, namespace = '{NS}' AS is_new FROM v WHERE NOT (coalesce(user_id = '{USER}', false) AND namespace = 'default')")
def vector_upsert_and_delete(spark, d):
    v = vectors(spark, d).withColumn("is_new", F.lit(False))
    new = v.where(F.col("namespace") == NS).withColumns({"importance": F.lit(9), "is_new": F.lit(True)})
    return writes.delete_vectors_of(writes.upsert_vectors(v, new), USER, "default").select("id", "importance", "is_new")


@query(_V + f"SELECT id, CASE WHEN namespace = '{NS}' THEN 5 ELSE importance END AS importance FROM v WHERE namespace <> 'default'")
def vector_payload(spark, d):
    v = vectors(spark, d)
    changed = writes.set_payload(v, v.where(F.col("namespace") == NS).select("id", F.lit(5).alias("importance")))
    return writes.delete_vectors(changed, v.where("namespace = 'default'").select("id")).select("id", "importance")


# dedup


def _incoming(spark, d) -> DataFrame:
    return read_table(spark, d, "memory_inputs").select(F.col("input_id").alias("ord"), "user_id", "content", "metadata", "namespace", "importance")


_DEDUP = f""", i AS (SELECT input_id AS ord, user_id, content, metadata, coalesce(namespace, 'default') AS namespace, sha256(content) AS content_hash FROM memory_inputs WHERE content IS NOT NULL),
h AS (SELECT namespace, content_hash, min(id) AS existing_id FROM m WHERE content_hash IS NOT NULL GROUP BY ALL),
exact AS (SELECT i.ord, h.existing_id FROM i JOIN h USING (namespace, content_hash)),
t AS (SELECT ord::VARCHAR AS k, true AS is_input, unnest(regexp_extract_all(lower(content), '{C.WORDS}')) AS w FROM i UNION ALL SELECT id, false, unnest(regexp_extract_all(lower(content), '{C.WORDS}')) FROM a),
b AS (SELECT k, is_input, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % {C.BUCKETS} AS b, count(*)::DOUBLE AS c FROM t GROUP BY ALL),
norm AS (SELECT k, is_input, sum(c * c) AS n FROM b GROUP BY ALL),
pairs AS (SELECT i.ord, a.id, CASE i.namespace WHEN 'user_facts' THEN 0.9 WHEN 'dialogue_insights' THEN 0.85 WHEN 'project_meta' THEN 0.9 ELSE 0.95 END AS least FROM i JOIN a ON a.user_id = i.user_id AND a.namespace = i.namespace),
dots AS (SELECT p.ord, p.id, any_value(p.least) AS least, sum(x.c * y.c) AS d FROM pairs p JOIN b x ON x.is_input AND x.k = p.ord::VARCHAR JOIN b y ON NOT y.is_input AND y.k = p.id AND y.b = x.b GROUP BY p.ord, p.id),
near AS (SELECT ord, d.id AS existing_id, round(d / sqrt(u.n * v.n), 6) AS score FROM dots d JOIN norm u ON u.is_input AND u.k = d.ord::VARCHAR JOIN norm v ON NOT v.is_input AND v.k = d.id WHERE d / sqrt(u.n * v.n) >= least
  QUALIFY row_number() OVER (PARTITION BY ord ORDER BY score DESC, d.id) <= 5),
best AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY ord ORDER BY score DESC, existing_id) = 1),
decided AS (SELECT i.ord, i.namespace, i.content_hash, e.existing_id AS exact_id, b.existing_id AS near_id, b.score, coalesce(length(x.n) > 0 AND length(y.n) > 0 AND x.n <> y.n, false) AS other
  FROM i LEFT JOIN exact e ON e.ord = i.ord LEFT JOIN best b ON b.ord = i.ord AND e.ord IS NULL
  LEFT JOIN (SELECT ord, lower(trim({_NAME})) AS n FROM i) x ON x.ord = i.ord LEFT JOIN (SELECT id, lower(trim({_NAME})) AS n FROM m) y ON y.id = b.existing_id),
out AS (SELECT ord, namespace, CASE WHEN exact_id IS NOT NULL THEN CASE namespace WHEN 'user_facts' THEN 'update' ELSE 'skip' END WHEN near_id IS NOT NULL AND NOT other THEN 'skip' ELSE 'insert' END AS action,
  coalesce(exact_id, CASE WHEN NOT other THEN near_id END) AS existing_id, CASE WHEN exact_id IS NULL AND NOT other THEN score END AS score, content_hash FROM decided)
"""


@query(_DEDUP + "SELECT * FROM exact")
def dedup_exact(spark, d):
    return dedup.exact(_incoming(spark, d), memories(spark, d))


@query(_DEDUP + "SELECT * FROM near")
def dedup_semantic(spark, d):
    return dedup.similar(_incoming(spark, d), memories(spark, d))


@query(_DEDUP + "SELECT ord, namespace, action, coalesce(existing_id, '') AS existing_id, coalesce(score, -1) AS score, content_hash FROM out")
def dedup_decisions(spark, d):
    return dedup.decisions(_incoming(spark, d), memories(spark, d)).withColumns({"existing_id": F.coalesce("existing_id", F.lit("")), "score": F.coalesce("score", F.lit(-1.0))})


@query(_DEDUP + "SELECT count(*) AS total, count(*) FILTER (action = 'insert') AS n_insert, count(*) FILTER (action = 'skip') AS n_skip, count(*) FILTER (action = 'update') AS n_update FROM out")
def dedup_summary(spark, d):
    return dedup.summary(dedup.decisions(_incoming(spark, d), memories(spark, d)))


@query(_DEDUP + "SELECT namespace, round(count(*) FILTER (action <> 'insert') / count(*)::DOUBLE, 6) AS dedup_ratio FROM out GROUP BY namespace")
def dedup_ratio(spark, d):
    return dedup.ratio(dedup.decisions(_incoming(spark, d), memories(spark, d)))


_HEX = f"md5(o.namespace || chr(31) || o.content_hash || chr(31) || '{NOW.isoformat(' ')}')"
_NEW_ID = "substr(#, 1, 8) || '-' || substr(#, 9, 4) || '-4' || substr(#, 14, 3) || '-a' || substr(#, 18, 3) || '-' || substr(#, 21, 12)".replace("#", _HEX)
_INS = """, ins AS (SELECT o.ord, row_number() OVER (PARTITION BY o.namespace, o.content_hash ORDER BY o.ord) = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.namespace = o.namespace AND a.content_hash = o.content_hash) AS made FROM out o WHERE action = 'insert'),
res AS (SELECT o.ord, o.namespace, CASE WHEN o.action = 'insert' AND NOT ins.made THEN 'skip' ELSE o.action END AS action, CASE WHEN o.action = 'insert' THEN """ + _NEW_ID + """ ELSE o.existing_id END AS id FROM out o LEFT JOIN ins USING (ord))
"""


@query(_DEDUP + _INS + "SELECT count(*) AS total, count(*) FILTER (action = 'insert') AS n_insert, count(*) FILTER (action = 'skip') AS n_skip, count(*) FILTER (action = 'update') AS n_update FROM res")
def ingest_summary(spark, d):
    return dedup.ingest_summary(dedup.ingest(_incoming(spark, d), reads.once(memories(spark, d)), relations(spark, d), read_table(spark, d, "memory_namespaces"), NOW)["results"])


@query(
    _DEDUP + _INS + f""", n AS (SELECT res.id, i.user_id, i.content, CASE WHEN json_valid(i.metadata) THEN i.metadata ELSE '{{}}' END AS j, i.namespace, i.content_hash FROM res JOIN i USING (ord) WHERE res.action = 'insert'),
l AS (SELECT id AS source_id, unnest(json_extract(j, '$.links[*]')) AS l FROM n),
e AS (SELECT source_id, json_extract_string(l, '$.type') AS link_type, json_extract_string(l, '$.target') AS target FROM l),
made AS (SELECT DISTINCT source_id, link_type, target FROM e WHERE link_type IS NOT NULL AND regexp_full_match(target, '{{C.UUID[1:-1]}}') AND target IN (SELECT id FROM m UNION SELECT id FROM n)
  UNION ALL SELECT source_id, link_type, target FROM e WHERE link_type IS NOT NULL AND NOT coalesce(regexp_full_match(target, '{{C.UUID[1:-1]}}'), false))
SELECT 'memory' AS kind, id AS a, content_hash AS b, user_id || '/' || namespace AS c FROM n UNION ALL SELECT 'relation', source_id, link_type, coalesce(target, '') FROM made
UNION ALL SELECT 'vector', id, namespace, '256' FROM n WHERE regexp_matches(content, '[\\p{{L}}\\p{{N}}]')""".replace("{{", "{").replace("}}", "}").replace("{C.UUID[1:-1]}", C.UUID[1:-1])
)
def store_pipeline(spark, d):
    """A batch stored as a whole: what it adds to memories, relations and vectors."""
    from loomstore.api import MemoryStore

    old = reads.once(memories(spark, d))
    vectors0 = spark.createDataFrame([], "id string, embedding array<float>, user_id string, namespace string, importance int")
    r = relations(spark, d)
    new, _ = MemoryStore(old, r, read_table(spark, d, "memory_namespaces"), spark.createDataFrame([], "source_type string"), vectors0, NOW).ingest(_incoming(spark, d))
    added = new.memories.join(old.select("id"), "id", "left_anti")
    links = new.relations.where(F.col("created_at") == writes.at(NOW)).join(added.select(F.col("id").alias("source_id")), "source_id", "left_semi")
    return (
        added.select(F.lit("memory").alias("kind"), F.col("id").alias("a"), F.col("content_hash").alias("b"), F.concat_ws("/", "user_id", "namespace").alias("c"))
        .unionByName(links.select(F.lit("relation").alias("kind"), F.col("source_id").alias("a"), F.col("link_type").alias("b"), F.coalesce("target_id", "target_name", F.lit("")).alias("c")))
        .unionByName(new.vectors.where(F.col("embedding").isNotNull()).select(F.lit("vector").alias("kind"), F.col("id").alias("a"), F.col("namespace").alias("b"), F.size("embedding").cast("string").alias("c")))
    )


@query(
    _DEDUP + """, ins AS (SELECT o.ord, row_number() OVER (PARTITION BY o.namespace, o.content_hash ORDER BY o.ord) = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.namespace = o.namespace AND a.content_hash = o.content_hash) AS made FROM out o WHERE action = 'insert')
SELECT o.ord, CASE WHEN o.action = 'insert' AND NOT ins.made THEN 'skip' ELSE o.action END AS action, o.namespace, CASE WHEN o.action = 'insert' THEN """ + _NEW_ID + """ ELSE o.existing_id END AS id FROM out o LEFT JOIN ins USING (ord)"""
)
def ingest_batch_results(spark, d):
    return dedup.ingest(_incoming(spark, d), reads.once(memories(spark, d)), relations(spark, d), read_table(spark, d, "memory_namespaces"), NOW)["results"]


# D17, D18, T08, 4.14: hashes; the log is made from events


def hash_log(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events").select(
        F.element_at(F.array(*[F.lit(x) for x in ("session", "file", "project")]), (F.col("event_id") % 3 + 1).cast("int")).alias("source_type"), F.col("user_id").cast("string").alias("source_id"),
        F.sha2("props", 256).alias("content_hash"), F.length("props").cast("long").alias("size_bytes"), F.concat(F.lit('{"project_id": "p'), F.col("user_id") % 5, F.lit('"}')).alias("metadata"), "ts", F.col("event_id").alias("ord"),
    )


_HASH = """WITH log AS (SELECT ['session', 'file', 'project'][event_id % 3 + 1] AS source_type, user_id::VARCHAR AS source_id, sha256(props) AS content_hash, length(props) AS size_bytes,
  '{"project_id": "p' || user_id % 5 || '"}' AS metadata, ts, event_id AS ord FROM events),
x AS (SELECT *, content_hash IS DISTINCT FROM lag(content_hash) OVER w OR row_number() OVER w = 1 AS changed FROM log WINDOW w AS (PARTITION BY source_type, source_id ORDER BY ts, ord)),
reg AS (SELECT source_type, source_id, arg_max(content_hash, (ts, ord)) AS content_hash, arg_max(size_bytes, (ts, ord)) AS size_bytes, arg_max(metadata, (ts, ord)) AS metadata, min(ts) AS created_at, max(ts) FILTER (changed) AS updated_at FROM x GROUP BY ALL)
"""


@query(_HASH + "SELECT * FROM reg", "")
def hash_fold(spark, d):
    return hashes.fold(hash_log(spark, d))


@query(
    _HASH + """, old AS (SELECT source_type, source_id, arg_max(content_hash, (ts, ord)) AS h FROM log WHERE ord % 2 = 0 GROUP BY ALL), new AS (SELECT source_type, source_id, arg_max(content_hash, ord) AS h FROM log WHERE ord % 2 = 1 GROUP BY ALL)
SELECT coalesce(n.source_type, o.source_type) AS source_type, coalesce(n.source_id, o.source_id) AS source_id, coalesce(n.h, o.h) AS content_hash, n.h IS NOT NULL AND n.h IS DISTINCT FROM o.h AS is_moved,
  CASE WHEN n.h IS NULL THEN 'kept' WHEN o.h IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM old o FULL JOIN new n ON n.source_type = o.source_type AND n.source_id = o.source_id""",
    "",
)
def hash_upsert(spark, d):
    log = hash_log(spark, d)
    out = hashes.upsert(hashes.fold(log.where("ord % 2 = 0")), log.where("ord % 2 = 1"), NOW)
    return out.select("source_type", "source_id", "content_hash", (F.col("updated_at") == writes.at(NOW)).alias("is_moved"), "action")


@query(_HASH + "SELECT * FROM reg WHERE source_type = 'file' AND source_id = '7'", "")
def hash_get(spark, d):
    return hashes.lookup(hashes.fold(hash_log(spark, d)), "file", "7")


@query(_HASH + "SELECT * FROM reg WHERE source_type = 'session' AND json_extract_string(metadata, '$.project_id') = 'p3' ORDER BY updated_at DESC, source_type, source_id LIMIT 20 OFFSET 5", "")
def hash_list(spark, d):
    return hashes.listing(hashes.fold(hash_log(spark, d)), "session", None, "p3", 20, 5)


@query(_HASH + "SELECT source_type, source_id FROM reg WHERE NOT (source_type = 'file' AND source_id = '7')", "")
def hash_delete(spark, d):
    return hashes.delete(hashes.fold(hash_log(spark, d)), "file", "7").select("source_type", "source_id")


@query(_HASH + "SELECT DISTINCT source_type, source_id, content_hash FROM log WHERE (source_type, source_id, content_hash) NOT IN (SELECT (source_type, source_id, content_hash) FROM reg)", "")
def hash_changed_resources(spark, d):
    return hashes.changed(hashes.fold(hash_log(spark, d)), hash_log(spark, d))


@query("SELECT CASE WHEN event_id % 7 = 0 THEN 'content_hash' WHEN event_id % 3 = 1 THEN 'source_type' ELSE '' END AS problem, count(*) AS n FROM events GROUP BY 1", "")
def hash_validate(spark, d):
    rows = hash_log(spark, d).withColumns({"content_hash": F.when(F.col("ord") % 7 == 0, "not-a-hash").otherwise(F.col("content_hash")), "source_type": F.when((F.col("ord") % 3 == 1) & (F.col("ord") % 7 != 0), "folder").otherwise(F.col("source_type"))})
    return hashes.problems(rows).groupBy(F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count(F.lit(1)).alias("n"))


# The ledger, made from the start of the id


def a_ledger(spark: SparkSession, d: str) -> DataFrame:
    k = F.conv(F.substring("id", 1, 4), 16, 10).cast("long") % 10
    m = reads.once(reads.active(memories(spark, d)).select("id")).where(k < 9)
    return m.select(F.col("id").alias("memory_id"), F.when(k < 7, "migrated").when(k == 7, "failed").otherwise("skipped").alias("status"), F.lit(None).cast("string").alias("error_msg"), F.lit(None).cast("timestamp_ntz").alias("migrated_at"))


_LEDGER = """, g AS (SELECT id AS memory_id, CASE WHEN k < 7 THEN 'migrated' WHEN k = 7 THEN 'failed' ELSE 'skipped' END AS status FROM (SELECT id, CAST('0x' || substr(id, 1, 4) AS INTEGER) % 10 AS k FROM a) WHERE k < 9),
s AS (SELECT * FROM g UNION ALL SELECT id, 'pending' FROM a WHERE id NOT IN (SELECT memory_id FROM g))
"""


@query(_LEDGER + "SELECT * FROM s")
def ledger_seed(spark, d):
    return ledger.seed(a_ledger(spark, d), memories(spark, d)).select("memory_id", "status")


@query(_LEDGER + "SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'migrated') AS migrated, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'skipped') AS skipped, CASE count(*) WHEN 0 THEN 100.0::DOUBLE ELSE round(count(*) FILTER (status = 'migrated') * 100.0::DOUBLE / count(*), 2) END AS pct_complete FROM s")
def ledger_status(spark, d):
    return ledger.status(ledger.seed(a_ledger(spark, d), memories(spark, d)))


@query(_LEDGER + "SELECT m.namespace, count(*) AS total, count(*) FILTER (status = 'migrated') AS migrated, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'failed') AS failed FROM s JOIN m ON m.id = s.memory_id GROUP BY m.namespace")
def ledger_by_namespace(spark, d):
    return ledger.by_namespace(ledger.seed(a_ledger(spark, d), memories(spark, d)), memories(spark, d))


@query(_LEDGER + "SELECT id, namespace FROM a WHERE id NOT IN (SELECT memory_id FROM g WHERE status NOT IN ('pending', 'failed'))")
def ledger_pending(spark, d):
    return ledger.pending(a_ledger(spark, d), memories(spark, d))


@query(_LEDGER + f"SELECT memory_id, CASE WHEN memory_id IN (SELECT id FROM a WHERE namespace = '{NS}') THEN 'failed' WHEN status = 'migrated' THEN 'pending' ELSE status END AS status FROM s")
def ledger_mark_and_reset(spark, d):
    ids = reads.active(memories(spark, d)).where(F.col("namespace") == NS).select(F.col("id").alias("memory_id"))
    return ledger.mark(ledger.reset(ledger.seed(a_ledger(spark, d), memories(spark, d))), ids, "failed", NOW, "x" * 600).select("memory_id", "status")


@query(_LEDGER + _V + ", n AS (SELECT (SELECT count(*) FROM a) AS n_memories, (SELECT count(*) FROM g WHERE status = 'migrated') AS n_migrated, (SELECT count(*) FROM v) AS n_vectors) SELECT *, CASE WHEN n_memories = n_migrated AND n_migrated = n_vectors THEN 'PERFECT' WHEN n_migrated = n_vectors THEN 'PARTIAL' ELSE 'MISMATCH' END AS verdict FROM n")
def ledger_reconcile(spark, d):
    return ledger.reconcile(memories(spark, d), a_ledger(spark, d), vectors(spark, d))


@query(_LEDGER + _V + """SELECT v.id, len(v.e) AS dims, array_to_string(list_sort(list_filter(['user_id=' || a.user_id, 'content=' || a.content, 'namespace=' || a.namespace, 'metadata=' || a.metadata, 'importance=' || coalesce(a.importance, 3), 'content_hash=' || a.content_hash,
  'created_at=' || strftime(a.created_at, '%Y-%m-%dT%H:%M:%S.%f')], lambda x: x IS NOT NULL)), chr(10)) AS fields FROM v JOIN a ON a.id = v.id""")
def ledger_points(spark, d):
    p = ledger.points(memories(spark, d), vectors(spark, d)).select("id", F.size("embedding").alias("dims"), F.from_json("payload", "map<string,string>").alias("j"))
    return p.select("id", "dims", F.array_join(F.array_sort(F.transform(F.map_entries("j"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "\n").alias("fields"))


# A18, A20, A21, 2.13: metrics, from events


def _log(spark, d) -> DataFrame:
    return read_table(spark, d, "events").select("ts", "event_type", "value", "user_id")


_BOUNDS = (1.0, 2.5, 5.0, 10.0, 25.0, 50.0, 100.0)
_HIST = f"""WITH les AS (SELECT unnest([{', '.join(str(b) + '::DOUBLE' for b in _BOUNDS)}, 'inf'::DOUBLE]) AS le),
h AS (SELECT event_type, le, (SELECT count(*) FROM events x WHERE x.event_type = t.event_type AND x.value <= le) AS n FROM (SELECT DISTINCT event_type FROM events WHERE value IS NOT NULL) t, les)
"""


@query(_HIST + "SELECT event_type, CASE WHEN isinf(le) THEN -1.0 ELSE le END AS le, n FROM h", "")
def metric_histogram(spark, d):
    return metrics.histogram(_log(spark, d), _BOUNDS, ["event_type"]).withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


@query(
    _HIST + """, t AS (SELECT event_type, max(n) AS total FROM h GROUP BY 1), o AS (SELECT h.*, 0.95::DOUBLE * total AS rank, lag(le) OVER w AS low, lag(n) OVER w AS base FROM h JOIN t USING (event_type) WINDOW w AS (PARTITION BY event_type ORDER BY le)),
f AS (SELECT * FROM o WHERE n >= rank QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY le) = 1)
SELECT event_type, round(CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (rank - coalesce(base, 0)) / (n - coalesce(base, 0)) END, 6) AS p95 FROM f""",
    "",
)
def metric_histogram_p95(spark, d):
    h = metrics.histogram(_log(spark, d), _BOUNDS, ["event_type"])
    return metrics.histogram_quantile(h, 0.95, ["event_type"]).select("event_type", F.round("quantile", 6).alias("p95"))


@query(
    """WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, round(avg(value) FILTER (i = (n - 1) // 2 OR i = n // 2), 6) AS median, max(value) FILTER (i = floor(n * 0.95)) AS p95, max(value) FILTER (i = floor(n * 0.99)) AS p99 FROM x GROUP BY event_type""",
    "",
)
def latency_percentiles(spark, d):
    return metrics.nearest_rank(_log(spark, d), ["event_type"], [0.95, 0.99]).withColumn("median", F.round("median", 6))


def _windows(width: int, step: int) -> str:
    return f"""WITH x AS (SELECT *, ceil(epoch_us(ts) / 1e6 / {step})::BIGINT * {step} AS first FROM events), w AS (SELECT *, unnest(range(first, first + {width}, {step})) AS "at" FROM x)
"""


@query(_windows(3600, 900) + 'SELECT "at", event_type, count(*) AS increase, round(count(*) / 3600.0::DOUBLE, 9) AS rate FROM w GROUP BY ALL', "")
def metric_rate(spark, d):
    return metrics.rate(_log(spark, d), ["event_type"], 3600, 900).withColumn("rate", F.round("rate", 9))


@query(
    _windows(7200, 1800) + """, s AS (SELECT "at", count(*) AS n, count(*) FILTER (event_type = 'error') / count(*)::DOUBLE AS ratio FROM w GROUP BY "at"), f AS (SELECT *, ratio > 0.2 AS firing, coalesce("at" - lag("at") OVER (ORDER BY "at"), 1800) AS gap FROM s),
g AS (SELECT *, sum(CASE WHEN NOT firing OR gap > 1800 THEN 1 ELSE 0 END) OVER (ORDER BY "at") AS run FROM f)
SELECT "at", n, round(ratio, 6) AS ratio, firing AND "at" - min("at") FILTER (firing) OVER (PARTITION BY run) >= 3600 AS alert FROM g""",
    "",
)
def alert_error_ratio(spark, d):
    r = metrics.ratio(_log(spark, d), F.col("event_type") == "error", [], 7200, 1800)
    return metrics.holds(r.withColumn("firing", F.col("ratio") > 0.2), [], 3600, 1800).select("at", "n", F.round("ratio", 6).alias("ratio"), "alert")


@query(
    _windows(3600, 1800) + """, s AS (SELECT event_type, "at", count(*) > 12 AS firing FROM w GROUP BY ALL),
f AS (SELECT *, coalesce("at" - lag("at") OVER (PARTITION BY event_type ORDER BY "at"), 1800) AS gap FROM s),
g AS (SELECT *, sum(CASE WHEN NOT firing OR gap > 1800 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY "at") AS run FROM f)
SELECT event_type, "at", firing AND "at" - min("at") FILTER (firing) OVER (PARTITION BY event_type, run) >= 1800 AS alert FROM g""",
    "",
)
def alert_backlog(spark, d):
    r = metrics.rate(_log(spark, d), ["event_type"], 3600, 1800).withColumn("firing", F.col("increase") > 12)
    return metrics.holds(r, ["event_type"], 1800, 1800).select("event_type", "at", "alert")


#: Fixed values: (rule, kind, metric, part, label, above, limit, for_s) of the twenty rules, over events in place of metrics
#: (the type is the metric, the user the label); thresholds are scaled to these and each window is a day long.
_RULES = (
    ("O01", "gauge", "signup", None, None, False, 1.0, 60), ("O02", "gauge", "click", None, None, True, 40.0, 300), ("O03", "rate", "error", None, None, True, 0.0, 0), ("O04", "age", "view", None, None, True, 3600.0, 0), ("O05", "age", "error", None, None, True, 3600.0, 600),
    ("O06", "age", "purchase", None, None, True, 7200.0, 3600), ("O07", "gauge", "view", None, None, False, 2.0, 60), ("O08", "gauge_ratio", "error", "view", None, True, 0.85, 0), ("O09", "ratio", "view", "error", None, True, 0.3, 600), ("O10", "p95", "view", None, None, True, 20.0, 0),
    ("O11", "gauge", "purchase", None, None, False, 1.5, 120), ("O12", "ratio", "click", "error", None, True, 0.1, 0), ("O13", "p95", "error", None, None, True, 30.0, 600), ("O14", "p95", "purchase", None, None, True, 5.0, 0), ("O15", "rate", "click", None, None, True, 0.0005, 0),
    ("O16", "rate", "signup", None, None, True, 0.0, 0), ("O17", "gauge", "error", None, None, True, 30.0, 300), ("O18", "ratio", "purchase", "error", None, True, 0.05, 0), ("O19", "p95", "signup", None, None, True, 10.0, 0), ("O20", "p95", "click", None, "7", True, 1.0, 0),
)
_RULE = "rule string, kind string, metric string, part string, label string, above boolean, `limit` double, for_s long"
_SQL_RULES = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x).lower() for x in r) + ")" for r in _RULES)


@query(
    _windows(86400, 21600).replace("FROM events)", "FROM events WHERE value IS NOT NULL)") + f""", u AS (SELECT * FROM (VALUES {_SQL_RULES}) t(rule, kind, metric, part, label, above, lim, for_s)),
les AS (SELECT unnest([{', '.join(str(b) + '::DOUBLE' for b in _BOUNDS)}, 'inf'::DOUBLE]) AS le),
j AS (SELECT u.*, w."at", w.user_id::VARCHAR AS series, w.value, w.ts, w.event_type = u.metric AS main FROM w JOIN u ON (w.event_type = u.metric OR w.event_type = u.part) AND (u.label IS NULL OR u.label = w.user_id::VARCHAR)),
h AS (SELECT rule, series, "at", le, count(*) FILTER (value <= le) AS n, count(*) AS total FROM j, les WHERE main AND kind = 'p95' GROUP BY ALL),
hh AS (SELECT *, lag(le) OVER o AS low, lag(n) OVER o AS base FROM h WINDOW o AS (PARTITION BY rule, series, "at" ORDER BY le)),
p AS (SELECT rule, series, "at", CASE WHEN isinf(le) THEN low ELSE coalesce(low, 0) + (le - coalesce(low, 0)) * (0.95::DOUBLE * total - coalesce(base, 0)) / (n - coalesce(base, 0)) END AS p95 FROM hh WHERE n >= 0.95::DOUBLE * total QUALIFY row_number() OVER (PARTITION BY rule, series, "at" ORDER BY le) = 1),
g AS (SELECT rule, kind, above, lim, for_s, series, "at", sum(value) FILTER (main) AS total, sum(value) FILTER (NOT main) AS part_total, max(value) FILTER (main) AS top, max(value) FILTER (NOT main) AS part_top, max(epoch_us(ts) / 1e6) FILTER (main) AS last FROM j GROUP BY ALL),
s AS (SELECT g.*, CASE kind WHEN 'rate' THEN total / 86400.0::DOUBLE WHEN 'ratio' THEN coalesce(part_total, 0) / nullif(coalesce(total, 0) + coalesce(part_total, 0), 0) WHEN 'gauge' THEN top WHEN 'gauge_ratio' THEN top / nullif(part_top, 0) WHEN 'p95' THEN p95 ELSE "at" - last END AS measure
  FROM g LEFT JOIN p USING (rule, series, "at")),
f AS (SELECT *, CASE WHEN above THEN measure > lim ELSE measure < lim END AS firing, coalesce("at" - lag("at") OVER (PARTITION BY rule, series ORDER BY "at"), 21600) AS gap FROM s WHERE measure IS NOT NULL),
k AS (SELECT *, sum(CASE WHEN NOT firing OR gap > 21600 THEN 1 ELSE 0 END) OVER (PARTITION BY rule, series ORDER BY "at") AS run FROM f)
SELECT rule, series, "at", round(measure, 6) AS measure, firing AND "at" - min("at") FILTER (firing) OVER (PARTITION BY rule, series, run) >= for_s AS alert FROM k""",
    "",
)
def alert_rules(spark, d):
    log = _log(spark, d).select("ts", F.col("event_type").alias("metric"), F.col("user_id").cast("string").alias("label"), "value")
    return metrics.alerts(log, spark.createDataFrame(list(_RULES), _RULE), _BOUNDS, 86400, 21600).withColumn("measure", F.round("measure", 6))


@query("SELECT event_type, round(epoch_us(TIMESTAMP '2026-06-01') / 1e6 - max(epoch_us(ts)) / 1e6, 3) AS age_s FROM events WHERE value > 50 GROUP BY event_type", "")
def metric_active_age(spark, d):
    return metrics.active_age(_log(spark, d), F.col("value") > 50, ["event_type"], writes.at(NOW)).withColumn("age_s", F.round("age_s", 3))


@query(
    """WITH s AS (SELECT event_type AS namespace, date_trunc('day', ts) AS "at", count(*) AS n FROM events GROUP BY ALL), t AS (SELECT "at", lag("at") OVER (ORDER BY "at") AS before FROM (SELECT DISTINCT "at" FROM s)),
k AS (SELECT namespace, "at" FROM s UNION SELECT s.namespace, t."at" FROM s JOIN t ON t.before = s."at")
SELECT k.namespace, k."at", CASE WHEN c.n IS NULL THEN 0.0 ELSE round((c.n - coalesce(p.n, 0)) / ((epoch_us(t."at") - epoch_us(t.before)) / 3.6e9), 2) END AS per_hour
FROM k JOIN t ON t."at" = k."at" AND t.before IS NOT NULL LEFT JOIN s c ON c.namespace = k.namespace AND c."at" = k."at" LEFT JOIN s p ON p.namespace = k.namespace AND p."at" = t.before""",
    "",
)
def growth_rate(spark, d):
    s = _log(spark, d).groupBy(F.col("event_type").alias("namespace"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    return metrics.growth(s)


@query("SELECT event_type, round(count(*) FILTER (user_id % 2 = 0) / count(*)::DOUBLE, 6) AS hit_ratio FROM events GROUP BY 1", "")
def cache_hit_ratio(spark, d):
    return metrics.hit_ratio(_log(spark, d), F.col("user_id") % 2 == 0, ["event_type"])


# ST1-ST5, ST7: streams over the files of a table, run until they are empty


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    path = Path(f"{d}/{name}.parquet")
    table = read_table(spark, d, name)
    folder = str(path) if path.is_dir() else str(path.parent)
    r = spark.readStream.schema(table.schema)
    return (r if path.is_dir() else r.option("pathGlobFilter", path.name)).parquet(folder)


@query("SELECT event_type, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL", "")
def stream_windows(spark, d):
    return streams.run_once(streams.tumbling(_stream(spark, d, "events"), "ts", "1 hour", ["event_type"]), "loom_windows", "complete").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "n")


@query(
    """WITH x AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
y AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM x) SELECT user_id, min(ts) AS opened, count(*) AS n FROM y GROUP BY user_id, s""",
    "",
)
def stream_sessions(spark, d):
    return streams.run_once(streams.sessions(_stream(spark, d, "events"), "ts", "6 hours", ["user_id"]), "loom_sessions", "complete").select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("opened"), "n")


@query("SELECT DISTINCT coalesce(namespace, 'default') AS namespace, sha256(content) AS own_hash FROM memory_inputs WHERE content IS NOT NULL", "")
def stream_dedup(spark, d):
    return streams.run_once(streams.first_contents(_stream(spark, d, "memory_inputs")).select("namespace", "own_hash"), "loom_dedup")


@query("SELECT namespace, count(*) AS n, round(count(*) FILTER (verdict <> 'insert') / count(*)::DOUBLE, 6) AS dedup_ratio FROM dedup_decisions GROUP BY namespace", "")
def stream_dedup_ratio(spark, d):
    s = streams.running_ratio(_stream(spark, d, "dedup_decisions").withColumnRenamed("verdict", "action"))
    return streams.run_once(s, "loom_ratio", "complete").select("namespace", "n", F.round("dedup_ratio", 6).alias("dedup_ratio"))


@query(f"SELECT id, created_at FROM m WHERE created_at > TIMESTAMP '2026-01-01'")
def stream_since(spark, d):
    return reads.once(streams.since(spark, f"{d}/memories.parquet", datetime(2026, 1, 1)).select("id", "created_at"))


@query(_HASH + "SELECT source_type, source_id, content_hash, updated_at FROM reg", "")
def stream_hash_state(spark, d):
    """The registry as keyed state: the last row of each resource."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    log = hash_log(spark, d).withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))
    s = _stream(spark, d, "events").select(
        F.element_at(F.array(*[F.lit(x) for x in ("session", "file", "project")]), (F.col("event_id") % 3 + 1).cast("int")).alias("source_type"), F.col("user_id").cast("string").alias("source_id"), F.sha2("props", 256).alias("content_hash"),
        F.length("props").cast("long").alias("size_bytes"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), F.col("event_id").alias("ord"),
    ).select(*[c for c in log.columns if c in ("source_type", "source_id", "content_hash", "size_bytes", "ts_us", "ord")])
    out = streams.run_once(streams.last_hashes(s), "loom_hashes", "update")
    last = out.groupBy("source_type", "source_id").agg(F.max_by("content_hash", "updated_us").alias("content_hash"), F.max("updated_us").alias("us"))
    return last.select("source_type", "source_id", "content_hash", F.timestamp_micros("us").cast("timestamp_ntz").alias("updated_at"))


@query(_DEDUP + _INS + "SELECT ord, namespace, action, id FROM res")
def stream_store_loop(spark, d):
    """The store grown by a stream: one file is one micro-batch, so its results are those of one ingest."""
    s = _stream(spark, d, "memory_inputs").select(F.col("input_id").alias("ord"), "user_id", "content", "metadata", "namespace", "importance")
    store = {"memories": reads.once(memories(spark, d)), "relations": relations(spark, d), "namespaces": read_table(spark, d, "memory_namespaces")}
    taken: list[DataFrame] = []
    streams.store_loop(s, store, NOW, lambda results, n: taken.append(scratch(results.select("ord", "namespace", "action", "id"), "results")))
    out = spark.createDataFrame([], "ord long, namespace string, action string, id string")
    for t in taken:
        out = out.unionByName(t)
    return out
