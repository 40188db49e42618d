"""Relations made, changed and removed; links inside metadata turned into relations."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.functions import columns as C
from loomstore.operators.reads import active, once
from loomstore.operators.writes import at, pick_per_key, replaces, upsert
from loomstore.schema import SYNCED

KEY = ("source_id", "target_id", "link_type")
LINKS = "array<struct<type string, target string, description string>>"


def explode_links(memories: DataFrame) -> DataFrame:
    """(source_id, ord, link_type, target, description, target_id): the links in each memory's metadata.

    Metadata that is no valid JSON has none.  ``target_id`` is the target where it is a lower-case UUID.
    """
    m = once(memories.where(F.col("metadata").contains('"links"')).select("id", "metadata")).where(F.try_parse_json("metadata").isNotNull())
    e = m.select(F.col("id").alias("source_id"), F.posexplode(F.from_json(F.get_json_object("metadata", "$.links"), LINKS)).alias("ord", "l"))
    return e.select(
        "source_id", "ord", F.col("l.type").alias("link_type"), F.col("l.target").alias("target"), F.col("l.description").alias("description"),
        F.when(C.is_uuid(F.col("l.target")), F.col("l.target")).alias("target_id"),
    )


def link_rows(memories: DataFrame, store: DataFrame, now: datetime) -> DataFrame:
    """Relations to be made from the links of ``memories``: typed, and with a target that is a name or a memory of ``store``.

    Of equal (source, target, type) the last by place counts; ids come from a hash of the row.
    """
    known = store.select(F.col("id").alias("known_id")).distinct()
    e = explode_links(memories).where(F.col("link_type").isNotNull()).join(known, F.col("target_id") == F.col("known_id"), "left")
    rows = e.where(F.col("target_id").isNull() | F.col("known_id").isNotNull()).select(
        F.md5(F.concat_ws("\x1f", "source_id", "target", "link_type", F.col("ord").cast("string"))).alias("id"), "source_id", "target_id",
        F.when(F.col("target_id").isNull(), F.col("target")).alias("target_name"), "link_type", "description", F.lit(1.0).alias("weight"), F.lit(SYNCED).alias("metadata"), at(now).alias("created_at"), "ord",
    )
    return pick_per_key(rows, KEY, "ord")


def upsert_relations(relations: DataFrame, rows: DataFrame, order: str = "ord", with_metadata: bool = True) -> DataFrame:
    """Description, weight and metadata replaced where (source, target, type) is there; without a target always a new row; with ``action``."""
    merge = {"description": replaces, "weight": replaces} | ({"metadata": replaces} if with_metadata else {})
    return upsert(relations, rows.select(*relations.columns, order), KEY, order, merge)


def delete_relation(relations: DataFrame, source_id: str, target_id: str, link_type: str) -> DataFrame:
    hit = (F.col("source_id") == source_id) & (F.col("target_id") == target_id) & (F.col("link_type") == link_type)
    return relations.where(~F.coalesce(hit, F.lit(False)))


def delete_by_source(relations: DataFrame, source_id: str) -> DataFrame:
    return relations.where(~F.coalesce(F.col("source_id") == source_id, F.lit(False)))


def is_synced():
    return F.coalesce(F.get_json_object("metadata", "$.synced_from") == "metadata.links", F.lit(False))


def delete_synced(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations of ``ids`` that came from metadata removed; those made by hand stay."""
    c = ids.select(F.col("id").alias("c_id")).distinct()
    return relations.join(c, (F.col("source_id") == F.col("c_id")) & is_synced(), "left_anti")


def backfill(relations: DataFrame, memories: DataFrame, now: datetime) -> DataFrame:
    """Relations with those from all live memories' links added; existing (source, target, type) stay untouched.

    Links to names never conflict, so a second backfill adds them again.
    """
    rows = link_rows(active(memories), memories, now)
    held = relations.where(F.col("target_id").isNotNull()).select(*KEY).distinct()
    return relations.unionByName(rows.join(held, list(KEY), "left_anti").select(*relations.columns))


def sync_batch(relations: DataFrame, memories: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """The relations from metadata of the memories ``ids`` made anew: old ones removed, present links upserted; with ``action``."""
    own = memories.join(ids.select("id").distinct(), "id", "left_semi")
    return upsert_relations(delete_synced(relations, ids), link_rows(own, memories, now))


def resolve(memories: DataFrame, wanted: DataFrame) -> DataFrame:
    """(entity, id): each wanted entity's memory, by id, else the oldest by entity name; null where there is neither."""
    by_id = once(memories.select("id")).select(F.col("id").alias("i_id"))
    named = once(memories.where(F.col("metadata").contains("entity_name")).select("id", "metadata", "created_at")).select(
        C.json_text(F.col("metadata"), "entity_name").alias("n_name"), F.struct("created_at", "id").alias("r")
    )
    by_name = named.where(F.col("n_name").isNotNull()).groupBy("n_name").agg(F.min("r").alias("r")).select("n_name", F.col("r.id").alias("n_id"))
    w = wanted.select("entity").distinct()
    return w.join(by_id, F.col("entity") == F.col("i_id"), "left").join(by_name, F.col("entity") == F.col("n_name"), "left").select("entity", F.coalesce("i_id", "n_id").alias("id"))


def link(relations: DataFrame, memories: DataFrame, source: str, target: str, link_type: str = "related_to", description: str | None = None, weight: float = 1.0, now: datetime | None = None) -> tuple[DataFrame, bool]:
    """(relations with the link, whether it was made): both ends by id or entity name; nothing where one isn't found."""
    now = now or datetime(1970, 1, 1)
    spark = relations.sparkSession
    ids = {r["entity"]: r["id"] for r in resolve(memories, spark.createDataFrame([(source,), (target,)], "entity string")).collect()}
    if not ids.get(source) or not ids.get(target):
        return relations, False
    row = spark.range(1).select(
        F.md5(F.lit(f"{ids[source]}\x1f{ids[target]}\x1f{link_type}")).alias("id"), F.lit(ids[source]).alias("source_id"), F.lit(ids[target]).alias("target_id"), F.lit(None).cast("string").alias("target_name"),
        F.lit(link_type).alias("link_type"), F.lit(description).cast("string").alias("description"), F.lit(float(weight)).alias("weight"), F.lit("{}").alias("metadata"), at(now).alias("created_at"), F.lit(0).alias("ord"),
    )
    return upsert_relations(relations, row).drop("action"), True
