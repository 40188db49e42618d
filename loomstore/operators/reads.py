"""Scans, lookups and listings of memories, relations and namespaces.

Every scan counts a row that was delivered twice once: one id is one record.  Optional arguments build no predicate
when they are None, so that what remains is pushed into the Parquet scan.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.functions import columns as C
from loomstore.schema import MEMORY_COLUMNS


#: Rows of a page that are broadcast to fetch its columns; longer ones are joined.
PAGE = 10_000


def shown(rows: DataFrame) -> DataFrame:
    """The columns that reads of memories return, with importance 3 where it is null or 0."""
    return rows.select(*[C.importance_or_default(F.col(c)).cast("int").alias(c) if c == "importance" else c for c in MEMORY_COLUMNS])


def where_equal(df: DataFrame, **values: object) -> DataFrame:
    """Equality on each column whose value is not None; a null column never matches."""
    for column, value in values.items():
        if value is not None:
            df = df.where(F.col(column) == F.lit(value))
    return df


def once(df: DataFrame, key: str = "id") -> DataFrame:
    """One row per id; apply filters before, as this shuffles."""
    return df.dropDuplicates([key])


def active(memories: DataFrame) -> DataFrame:
    """Memories that are not archived; a null flag counts as live."""
    return memories.where(~F.coalesce("is_archived", F.lit(False)))


def clean_relations(relations: DataFrame) -> DataFrame:
    """Relations with ids in lower case and link types in one spelling, one row per id."""
    low = relations.select(
        F.lower("id").alias("id"), F.lower("source_id").alias("source_id"), F.lower("target_id").alias("target_id"), "target_name",
        F.translate(F.lower(F.trim("link_type")), "-", "_").alias("link_type"), "description", "weight", "metadata", "created_at",
    )
    return once(low)


def get(memories: DataFrame, memory_id: str) -> DataFrame:
    """The memory of an id, archived or not; no row where there is none."""
    return once(shown(memories.where(F.col("id") == memory_id)))


def by_hash(memories: DataFrame, namespace: str, content_hash: str) -> DataFrame:
    """Memories of a namespace with a content hash, archived or not."""
    return once(shown(where_equal(memories, namespace=namespace, content_hash=content_hash)))


def by_entity_name(memories: DataFrame, name: str) -> DataFrame:
    """The oldest memory (ties: smaller id) whose metadata names the entity exactly so."""
    hit = memories.where(F.col("metadata").contains("entity_name") & (C.json_text(F.col("metadata"), "entity_name") == name))
    return once(shown(hit)).orderBy("created_at", "id").limit(1)


def fetch(memories: DataFrame, ids: DataFrame) -> DataFrame:
    """The live memories of ``ids`` (id); unknown and archived ones are left out."""
    return once(shown(active(memories).join(ids.select("id").distinct(), "id", "left_semi")))


def listing(memories: DataFrame, user_id: str | None = None, namespace: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of live memories, newest first (ties: smaller id)."""
    rows = where_equal(active(memories), user_id=user_id, namespace=namespace)
    return page(rows, limit, offset)


def page(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of memories, newest first (ties: smaller id): chosen on time and id alone, the other columns fetched for it.

    The page is a table of at most ``limit`` rows, so its join needs no shuffle of the memories.
    """
    keys = once(rows.select("id", "created_at")).orderBy(F.desc("created_at"), "id").offset(offset).limit(limit).select("id")
    wanted = F.broadcast(keys) if limit <= PAGE else keys
    return once(shown(rows.join(wanted, "id", "left_semi"))).orderBy(F.desc("created_at"), "id")


def listing_with_count(memories: DataFrame, user_id: str | None = None, namespace: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page as :func:`listing`, each row with the number of all rows; the count is its own aggregate, not a window over one partition."""
    hits = where_equal(active(memories), user_id=user_id, namespace=namespace)
    total = hits.agg(F.count_distinct("id").alias("total_count"))
    return listing(memories, user_id, namespace, limit, offset).crossJoin(F.broadcast(total)).orderBy(F.desc("created_at"), "id")


def count(memories: DataFrame, user_id: str | None = None, namespace: str | None = None) -> DataFrame:
    """The number of memories, archived ones included."""
    return where_equal(memories, user_id=user_id, namespace=namespace).agg(F.count_distinct("id").alias("n"))


def recent(memories: DataFrame, namespace: str | None = None, since: datetime | None = None, limit: int = 20) -> DataFrame:
    """Live memories created at or after ``since``, newest first."""
    rows = where_equal(active(memories), namespace=namespace)
    if since is not None:
        rows = rows.where(F.col("created_at") >= F.lit(since).cast("timestamp_ntz"))
    return page(rows, limit)


def stats(memories: DataFrame, user_id: str | None = None) -> DataFrame:
    """Live memories and the last change per namespace; a null namespace is a group."""
    rows = where_equal(active(memories), user_id=user_id)
    return once(rows.select("id", "namespace", "updated_at")).groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), F.max("updated_at").alias("last_updated")).orderBy("namespace")


def namespaces(table: DataFrame) -> DataFrame:
    """uid, name and description (null as empty) in the order of uid."""
    return table.select("uid", "name", F.coalesce("description", F.lit("")).alias("description")).distinct().orderBy("uid")


def of_ends(relations: DataFrame, source_id: str | None = None, target_id: str | None = None) -> DataFrame:
    """The rows with these ends in any letter case, by a filter that stands below the removal of repeated deliveries."""
    for column, value in (("source_id", source_id), ("target_id", target_id)):
        if value is not None:
            relations = relations.where(F.lower(column) == value.lower())
    return relations


def relations_by_source(relations: DataFrame, source_id: str, link_type: str | None = None) -> DataFrame:
    return where_equal(clean_relations(of_ends(relations, source_id)), source_id=source_id, link_type=link_type).orderBy(F.desc("created_at"), "id")


def relations_by_target(relations: DataFrame, target_id: str, link_type: str | None = None) -> DataFrame:
    return where_equal(clean_relations(of_ends(relations, None, target_id)), target_id=target_id, link_type=link_type).orderBy(F.desc("created_at"), "id")


def relations_between(relations: DataFrame, source_id: str, target_id: str) -> DataFrame:
    return where_equal(clean_relations(of_ends(relations, source_id, target_id)), source_id=source_id, target_id=target_id)


def relations_unified(relations: DataFrame, memory_id: str, link_type: str | None = None) -> DataFrame:
    """Outgoing and incoming relations with their direction; a loop of one is both."""
    either = relations.where((F.lower("source_id") == memory_id.lower()) | (F.lower("target_id") == memory_id.lower()))
    r = where_equal(clean_relations(either), link_type=link_type)
    out = r.where(F.col("source_id") == memory_id).withColumn("direction", F.lit("outgoing"))
    return out.unionByName(r.where(F.col("target_id") == memory_id).withColumn("direction", F.lit("incoming"))).orderBy(F.desc("created_at"), "id", "direction")


def as_json(rows: DataFrame, drop_nulls: bool = True) -> DataFrame:
    """Each row as one JSON text; null fields are left out, times are ISO texts."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": str(drop_nulls).lower(), "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("json"))


def from_arrays(spark, **arrays: list) -> DataFrame:
    """Parallel arrays as rows by position, with their place ``ord``; shorter arrays are filled with nulls."""
    kinds = {k: {int: "long", float: "double", bool: "boolean"}.get(next((type(x) for x in a if x is not None), str), "string") for k, a in arrays.items()}
    one = spark.createDataFrame([tuple(list(a) for a in arrays.values())], ", ".join(f"{k} array<{t}>" for k, t in kinds.items())) if arrays else spark.createDataFrame([], "none array<string>")
    zipped = one.select(F.posexplode(F.arrays_zip(*[F.col(c) for c in one.columns])).alias("ord", "x"))
    return zipped.select(*[F.col(f"x.{k}").alias(k) for k in arrays], "ord")
