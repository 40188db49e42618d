"""Registry of resource hashes for change detection.

A log is (source_type, source_id, content_hash, size_bytes, metadata, ts, ord); the registry has the last values of
each (source_type, source_id), and ``updated_at`` moves only when the hash changes.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.operators.writes import at, pick_per_key
from loomstore.schema import SOURCE_TYPES

HASH = "^[a-f0-9]{64}$"
KEY = ("source_type", "source_id")
MAX_METADATA = 65536
MAX_PAGE = 500


def problems(rows: DataFrame) -> DataFrame:
    """``rows`` with ``problem``: why a row would be refused, null where it would not."""
    blank = lambda c: F.coalesce(F.length(F.trim(c)) == 0, F.lit(True))
    return rows.withColumn(
        "problem",
        F.when(blank("source_type") | blank("source_id") | blank("content_hash"), "blank").when(~F.col("source_type").isin(*SOURCE_TYPES), "source_type")
        .when(~F.col("content_hash").rlike(HASH), "content_hash").when(F.coalesce(F.length("metadata"), F.lit(0)) > MAX_METADATA, "metadata"),
    )


def fold(log: DataFrame) -> DataFrame:
    """(source_type, source_id, content_hash, size_bytes, metadata, created_at, updated_at) of a whole log, in the order of (ts, ord).

    The hash last changed at the first row after the last one with another hash.  Both are found by aggregates, not by
    sorting a resource's rows, so a resource that holds a third of the log is reduced in the map tasks.  A null hash is
    a hash like any other.
    """
    turn = F.struct("ts", "ord")
    last = log.groupBy(*KEY).agg(
        F.max_by("content_hash", turn).alias("content_hash"), F.max_by("size_bytes", turn).alias("size_bytes"), F.max_by("metadata", turn).alias("metadata"), F.min("ts").alias("created_at")
    )
    rows = log.select(*KEY, "content_hash", turn.alias("turn")).join(last.select(*KEY, F.col("content_hash").alias("last_hash")), list(KEY))
    same = F.col("content_hash").eqNullSafe(F.col("last_hash"))
    other = rows.where(~same).groupBy(*KEY).agg(F.max("turn").alias("other"))
    changed = rows.where(same).join(other, list(KEY), "left").where(F.col("other").isNull() | (F.col("turn") > F.col("other"))).groupBy(*KEY).agg(F.min("turn.ts").alias("updated_at"))
    return last.join(changed, list(KEY)).select(*KEY, "content_hash", "size_bytes", "metadata", "created_at", "updated_at")


def upsert(registry: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """The registry after a batch (last change per key by ``ord``), with ``action``; an equal hash keeps ``updated_at``."""
    c = pick_per_key(changes, KEY, "ord").select(*[F.col(x).alias(f"c_{x}") for x in ("source_type", "source_id", "content_hash", "size_bytes", "metadata")], F.lit(True).alias("c_here"))
    j = registry.withColumn("r_here", F.lit(True)).join(c, (F.col("source_type") == F.col("c_source_type")) & (F.col("source_id") == F.col("c_source_id")), "full")
    given, old = F.col("c_here").isNotNull(), F.col("r_here").isNotNull()
    new = lambda x: F.when(given, F.col(f"c_{x}")).otherwise(F.col(x)).alias(x)
    moved = given & (~old | ~F.col("content_hash").eqNullSafe(F.col("c_content_hash")))
    return j.select(
        new("source_type"), new("source_id"), new("content_hash"), new("size_bytes"), new("metadata"), F.when(old, F.col("created_at")).otherwise(at(now)).alias("created_at"),
        F.when(moved, at(now)).otherwise(F.col("updated_at")).alias("updated_at"), F.when(given & old, "updated").when(given, "inserted").otherwise("kept").alias("action"),
    )


def lookup(registry: DataFrame, source_type: str, source_id: str) -> DataFrame:
    return registry.where((F.col("source_type") == source_type) & (F.col("source_id") == source_id))


def listing(registry: DataFrame, source_type: str | None = None, since: datetime | None = None, project_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page, last changed first (ties by key); at most 500 rows."""
    if source_type is not None:
        registry = registry.where(F.col("source_type") == source_type)
    if since is not None:
        registry = registry.where(F.col("updated_at") >= at(since))
    if project_id is not None:
        registry = registry.where(F.get_json_object("metadata", "$.project_id") == project_id)
    return registry.orderBy(F.desc("updated_at"), *KEY).offset(offset).limit(min(limit, MAX_PAGE))


def delete(registry: DataFrame, source_type: str, source_id: str) -> DataFrame:
    return registry.where(~F.coalesce((F.col("source_type") == source_type) & (F.col("source_id") == source_id), F.lit(False)))


def changed(registry: DataFrame, seen: DataFrame) -> DataFrame:
    """The (source_type, source_id, content_hash) of ``seen`` that the registry lacks or has with another hash."""
    return seen.select(*KEY, "content_hash").distinct().join(registry.select(*KEY, "content_hash"), [*KEY, "content_hash"], "left_anti")
