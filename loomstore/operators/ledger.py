"""Ledger of records copied to another store: states, progress, what is left to do.

A ledger is (memory_id, status, error_msg, migrated_at) with the states pending, migrated, failed and skipped.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.operators.reads import active, once
from loomstore.operators.writes import at
from loomstore.schema import LEDGER_STATES


def seed(ledger: DataFrame, memories: DataFrame) -> DataFrame:
    """Live memories that the ledger lacks added as pending."""
    new = once(active(memories).select("id")).join(ledger.select(F.col("memory_id").alias("id")), "id", "left_anti")
    return ledger.unionByName(new.select(F.col("id").alias("memory_id"), F.lit("pending").alias("status"), F.lit(None).cast("string").alias("error_msg"), F.lit(None).cast("timestamp_ntz").alias("migrated_at")))


def mark(ledger: DataFrame, ids: DataFrame, status: str, now: datetime, error: str | None = None) -> DataFrame:
    """The state of ``ids`` (memory_id) set, rows made where missing; errors are cut to 500 characters."""
    if status not in LEDGER_STATES:
        raise ValueError(f"no such state: {status}")
    m = ids.select("memory_id").distinct()
    rest = ledger.join(m, "memory_id", "left_anti")
    done = at(now) if status == "migrated" else F.lit(None).cast("timestamp_ntz")
    return rest.unionByName(m.select("memory_id", F.lit(status).alias("status"), F.left(F.lit(error).cast("string"), F.lit(500)).alias("error_msg"), done.alias("migrated_at")))


def reset(ledger: DataFrame) -> DataFrame:
    """Migrated records back to pending."""
    return ledger.withColumns({"status": F.when(F.col("status") == "migrated", "pending").otherwise(F.col("status")), "migrated_at": F.lit(None).cast("timestamp_ntz")})


def status(ledger: DataFrame) -> DataFrame:
    """Numbers by state and the share migrated in percent; 100 for an empty ledger."""
    n = F.count(F.lit(1))
    return ledger.agg(
        n.alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in LEDGER_STATES],
        F.when(n == 0, 100.0).otherwise(F.round(F.count_if(F.col("status") == "migrated") * 100.0 / n, 2)).alias("pct_complete"),
    )


def by_namespace(ledger: DataFrame, memories: DataFrame) -> DataFrame:
    m = once(memories.select("id", "namespace"))
    return ledger.join(m, F.col("memory_id") == F.col("id")).groupBy("namespace").agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("migrated", "pending", "failed")])


def pending(ledger: DataFrame, memories: DataFrame) -> DataFrame:
    """Live memories without an entry, or with one that is pending or failed."""
    done = ledger.where(~F.col("status").isin("pending", "failed")).select(F.col("memory_id").alias("id"))
    return once(active(memories).select("id", "namespace")).join(done, "id", "left_anti")


def points(memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Memories with their vector as (id, embedding, payload): the payload is JSON without null fields, importance null as 3."""
    m = once(active(memories)).select(
        "id",
        F.to_json(F.struct("user_id", "content", "namespace", "metadata", F.coalesce("importance", F.lit(3)).alias("importance"), "content_hash", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("created_at"))).alias("payload"),
    )
    return m.join(vectors.select("id", "embedding"), "id").select("id", "embedding", "payload")


def reconcile(memories: DataFrame, ledger: DataFrame, vectors: DataFrame) -> DataFrame:
    """Numbers of live memories, migrated entries and vectors, and what they say together."""
    m = active(memories).agg(F.count_distinct("id").alias("n_memories"))
    g = ledger.agg(F.count_if(F.col("status") == "migrated").alias("n_migrated"))
    v = vectors.agg(F.count(F.lit(1)).alias("n_vectors"))
    all_equal = (F.col("n_memories") == F.col("n_migrated")) & (F.col("n_migrated") == F.col("n_vectors"))
    return m.crossJoin(g).crossJoin(v).withColumn("verdict", F.when(all_equal, "PERFECT").when(F.col("n_migrated") == F.col("n_vectors"), "PARTIAL").otherwise("MISMATCH"))


def progress(done: int, total: int, seconds: float) -> dict[str, float]:
    """Rate, percent and seconds left, 0 where they are undefined."""
    rate = done / seconds if seconds > 0 else 0.0
    return {"rate": rate, "pct": 100.0 * done / total if total > 0 else 0.0, "eta": (total - done) / rate if rate > 0 else 0.0}
