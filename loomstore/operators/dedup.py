"""Dedup decisions for incoming entries: exact by hash, then by similarity of the built-in embedding.

Incoming entries are (ord, user_id, content, metadata, namespace, importance).  The store is never changed by a
decision: entries of one batch are judged against the store only.
"""

from __future__ import annotations

from datetime import datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstore.functions import columns as C
from loomstore.operators import links
from loomstore.operators.reads import active, once
from loomstore.operators.writes import at, ensure_namespaces, insert_memories_ignore
from loomstore.sources.tables import scratch

#: Stored texts of one block of a (user, namespace) that is scored at a time.
BLOCK = 20_000


def prepared(incoming: DataFrame) -> DataFrame:
    """Incoming entries with a namespace (null as default) and the hash of their content; null contents are left out."""
    return incoming.where(F.col("content").isNotNull()).select(
        F.col("ord").cast("long").alias("ord"), "user_id", "content", "metadata", F.coalesce("namespace", F.lit("default")).alias("namespace"), "importance", C.sha256(F.col("content")).alias("content_hash")
    )


def exact(incoming: DataFrame, memories: DataFrame, include_archived: bool = True) -> DataFrame:
    """(ord, existing_id): entries whose (namespace, content hash) the store has; of several the smallest id."""
    store = memories if include_archived else active(memories)
    rows = prepared(incoming).select("ord", "namespace", "content_hash")
    asked = rows.select("namespace", "content_hash").distinct()
    held = store.where(F.col("content_hash").isNotNull()).select("namespace", "content_hash", "id").join(asked, ["namespace", "content_hash"], "left_semi")
    held = held.groupBy("namespace", "content_hash").agg(F.min("id").alias("existing_id"))
    return rows.join(held, ["namespace", "content_hash"]).select("ord", "existing_id")


def _score_block(limit: int):
    def run(table: pa.Table) -> pa.Table:
        ask = table.column("ask").to_numpy(zero_copy_only=False)
        stored, asked = table.filter(pa.array(~ask)).sort_by("id"), table.filter(pa.array(ask))
        names, ords, out = stored.column("id").to_pylist(), asked.column("ord").to_numpy(), ([], [], [])

        def matrix(t: pa.Table) -> np.ndarray:
            lists = t.column("buckets").combine_chunks()
            flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            row = np.repeat(np.arange(len(sizes)), sizes)
            return np.bincount(row * C.BUCKETS + flat, minlength=len(sizes) * C.BUCKETS).reshape(-1, C.BUCKETS).astype(np.float64)

        if names and len(ords):
            v, least = matrix(stored), asked.column("threshold").to_numpy()
            nv = np.sqrt((v * v).sum(axis=1))
            for i in range(0, len(ords), 512):
                q = matrix(asked.slice(i, 512))
                s = (q @ v.T) / np.maximum(np.sqrt((q * q).sum(axis=1))[:, None] * nv[None], 1e-300)
                for j in range(len(q)):
                    good = np.flatnonzero(s[j] >= least[i + j])
                    good = good[np.argsort(-np.round(s[j][good], 6), kind="stable")[:limit]]
                    out[0].extend([ords[i + j]] * len(good))
                    out[1].extend(names[k] for k in good)
                    out[2].extend(np.round(s[j][good], 6).tolist())
        return pa.table({"ord": pa.array(out[0], pa.int64()), "existing_id": pa.array(out[1], pa.string()), "score": pa.array(out[2], pa.float64())})

    return run


def similar(incoming: DataFrame, memories: DataFrame, k: int = 5) -> DataFrame:
    """(ord, existing_id, score): up to k live memories of the same user and namespace at or above the namespace's threshold.

    The store's texts and the entries of a (user, namespace) are dealt to blocks of bounded size, however many there
    are; each pair of blocks is one matrix product.
    """
    store = once(active(memories).select("id", "user_id", "namespace", "content")).where(F.col("content").isNotNull() & F.col("user_id").isNotNull())
    rows = prepared(incoming)
    store = store.join(rows.select("user_id", "namespace").distinct(), ["user_id", "namespace"], "left_semi")
    blocks = lambda name: (F.floor(F.count(F.lit(1)) / BLOCK) + 1).cast("int").alias(name)
    pairs = rows.groupBy("user_id", "namespace").agg(blocks("turns"))
    sizes = store.groupBy("user_id", "namespace").agg(blocks("blocks")).join(pairs, ["user_id", "namespace"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    asked = rows.join(sizes, ["user_id", "namespace"]).select(
        "user_id", "namespace", every("blocks").alias("block"), part("ord", "turns").alias("turn"), F.lit(None).cast("string").alias("id"), "ord",
        C.buckets(F.col("content")).alias("buckets"), C.threshold(F.col("namespace")).alias("threshold"), F.lit(True).alias("ask"),
    )
    stored = store.join(sizes, ["user_id", "namespace"]).select(
        "user_id", "namespace", part("id", "blocks").alias("block"), every("turns").alias("turn"), "id", F.lit(None).cast("long").alias("ord"),
        C.buckets(F.col("content")).alias("buckets"), F.lit(None).cast("double").alias("threshold"), F.lit(False).alias("ask"),
    )
    hits = stored.unionByName(asked).groupBy("user_id", "namespace", "block", "turn").applyInArrow(_score_block(k), "ord long, existing_id string, score double")
    w = Window.partitionBy("ord").orderBy(F.desc("score"), "existing_id")
    return hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def decisions(incoming: DataFrame, memories: DataFrame, enabled: bool = True, include_archived: bool = True) -> DataFrame:
    """(ord, namespace, action, existing_id, score, content_hash), one row per entry with a content.

    An exact hit is an update in ``user_facts`` and a skip elsewhere; else the most similar memory makes a skip,
    unless both name an entity and the names differ; everything else is inserted.
    """
    rows = prepared(incoming)
    if not enabled:
        return rows.select("ord", "namespace", F.lit("insert").alias("action"), F.lit(None).cast("string").alias("existing_id"), F.lit(None).cast("double").alias("score"), "content_hash")
    hit = exact(incoming, memories, include_archived).select("ord", F.col("existing_id").alias("exact_id"))
    rest = incoming.join(hit.select("ord"), "ord", "left_anti")
    best = similar(rest, memories, 1).select("ord", F.col("existing_id").alias("near_id"), F.col("score").alias("near_score"))
    named = once(memories.select("id", "metadata")).join(best.select(F.col("near_id").alias("id")), "id", "left_semi").select(
        F.col("id").alias("m_id"), C.plain_name(C.json_text(F.col("metadata"), "entity_name")).alias("m_name")
    )
    j = rows.join(hit, "ord", "left").join(best, "ord", "left").join(named, F.col("near_id") == F.col("m_id"), "left")
    own = C.plain_name(C.json_text(F.col("metadata"), "entity_name"))
    other = F.coalesce((F.length(own) > 0) & (F.length("m_name") > 0) & (own != F.col("m_name")), F.lit(False))
    near = F.col("near_id").isNotNull() & ~other
    return j.select(
        "ord", "namespace",
        F.when(F.col("exact_id").isNotNull(), F.when(F.col("namespace") == "user_facts", "update").otherwise("skip")).when(near, "skip").otherwise("insert").alias("action"),
        F.coalesce("exact_id", F.when(near, F.col("near_id"))).alias("existing_id"),
        F.when(F.col("exact_id").isNull() & near, F.col("near_score")).alias("score"), "content_hash",
    )


def summary(decided: DataFrame) -> DataFrame:
    """One row: total and the number of each action."""
    return decided.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("action") == a).alias(f"n_{a}") for a in ("insert", "skip", "update")])


def ratio(decided: DataFrame) -> DataFrame:
    """Per namespace the share of entries that were not inserted."""
    return decided.groupBy("namespace").agg(F.round(F.count_if(F.col("action") != "insert") / F.count(F.lit(1)), 6).alias("dedup_ratio"))


def ingest_summary(results: DataFrame) -> DataFrame:
    """One row on a batch: total and what became of its entries."""
    return summary(results)


def ingest(incoming: DataFrame, memories: DataFrame, relations: DataFrame, namespaces: DataFrame, now: datetime, apply_updates: bool = False) -> dict[str, DataFrame]:
    """A batch taken in: results (ord, action, namespace, id), memories, relations and namespaces afterwards.

    ``id`` is the memory that an entry became or was found to be.  Entries to be inserted that repeat a (namespace,
    content) of the batch are skipped but for the first.  New ids come from a hash of namespace, content and ``now``, so
    that a batch gives the same ids when it is run again, and a content that was forgotten another id later.  With
    ``apply_updates`` the metadata of updates is merged into the store, as a single store call does.
    """
    decided = scratch(decisions(incoming, memories), "decisions")
    registry = ensure_namespaces(namespaces, decided.select(F.col("namespace").alias("uid")), now)
    ready = scratch(prepared(incoming), "prepared")
    rows = ready.join(decided.where(F.col("action") == "insert").select("ord"), "ord", "left_semi")
    ids = registry.groupBy(F.col("uid").alias("namespace")).agg(F.min("id").alias("namespace_id"))
    h = F.md5(F.concat_ws("\x1f", "namespace", "content_hash", F.lit(now.isoformat(" "))))
    new_id = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    fresh = rows.join(ids, "namespace", "left").select(
        new_id.alias("id"),
        "user_id", "content", F.coalesce("metadata", F.lit("{}")).alias("metadata"), "namespace", "namespace_id", "content_hash", F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("source_location"),
        F.lit(1).alias("version"), F.lit(False).alias("is_archived"), C.importance_or_default(F.col("importance")).cast("int").alias("importance"), at(now).alias("created_at"), at(now).alias("updated_at"), "ord",
    )
    store, inserted = insert_memories_ignore(memories, fresh)
    inserted = scratch(inserted, "inserted")
    results = decided.join(inserted.select("ord", F.lit(True).alias("made")), "ord", "left").select(
        "ord", F.when((F.col("action") == "insert") & F.col("made").isNull(), "skip").otherwise(F.col("action")).alias("action"), "namespace",
        F.when(F.col("action") == "insert", new_id).otherwise(F.col("existing_id")).alias("id"),
    )
    store = memories.unionByName(inserted.select(*memories.columns))
    if apply_updates:
        given = decided.where(F.col("action") == "update").join(ready.select("ord", "metadata"), "ord").groupBy(F.col("existing_id").alias("u_id")).agg(F.max_by("metadata", "ord").alias("u_metadata"))
        hit = F.col("u_id").isNotNull()
        store = store.join(given, F.col("id") == F.col("u_id"), "left").withColumns(
            {"metadata": F.when(hit, F.to_json(C.merge_metadata(F.col("metadata"), F.col("u_metadata")))).otherwise(F.col("metadata")), "updated_at": F.when(hit, at(now)).otherwise(F.col("updated_at"))}
        ).select(*memories.columns)
    touched = inserted.select("id").unionByName(decided.where(F.col("existing_id").isNotNull()).select(F.col("existing_id").alias("id")))
    return {"results": results, "memories": store, "relations": links.sync_batch(relations, store, touched, now).drop("action"), "namespaces": registry}
