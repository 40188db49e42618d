"""Inserts, updates and deletes as functions from a table and its changes to the new table.

Parquet has no MERGE: a caller writes the returned table as the next snapshot.  Times are arguments, so results are
repeatable.  Keys compare null-safely only where said; a null key part never conflicts.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstore.functions import columns as C
from loomstore.operators.reads import once


def at(now: datetime) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def pick_per_key(changes: DataFrame, keys: Sequence[str], order: str, last: bool = True) -> DataFrame:
    """One change per key: the one with the largest (or smallest) ``order``; rows with a null key part are all kept.

    Written as an aggregate, so that a key that holds many changes is reduced before the shuffle.
    """
    full = F.lit(True)
    for k in keys:
        full = full & F.col(k).isNotNull()
    rest = [c for c in changes.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    kept = changes.where(full).groupBy(*keys).agg(pick(F.struct(*rest), F.col(order)).alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return kept.select(*changes.columns).unionByName(changes.where(~full))


def insert_ignore(state: DataFrame, changes: DataFrame, keys: Sequence[str], order: str, counted: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(new state, inserted): first change per key, unless the state (or what ``counted`` leaves of it) has the key."""
    first = pick_per_key(changes, keys, order, last=False)
    held = (counted(state) if counted else state).select(*keys).distinct()
    inserted = first.join(held, list(keys), "left_anti")
    return state.unionByName(inserted.select(*state.columns)), inserted


def upsert(state: DataFrame, changes: DataFrame, keys: Sequence[str], order: str, merge: dict[str, Callable[[Column, Column], Column]]) -> DataFrame:
    """The state with the last change per key merged in, and ``action`` (kept, updated or inserted).

    ``merge`` says per column what a matched row becomes from the old and the new value; other columns keep the old.
    Changes with a null key part are always inserted.
    """
    new = pick_per_key(changes, keys, order).select(*[F.col(c).alias(f"n_{c}") for c in state.columns], F.lit(True).alias("n_here"))
    old = state.select(*[F.col(c).alias(f"o_{c}") for c in state.columns], F.lit(True).alias("o_here"))
    on = F.lit(True)
    for k in keys:
        on = on & (F.col(f"o_{k}") == F.col(f"n_{k}"))
    both = old.join(new, on, "full")
    matched = F.col("o_here").isNotNull() & F.col("n_here").isNotNull()
    out = []
    for c in state.columns:
        o, n = F.col(f"o_{c}"), F.col(f"n_{c}")
        changed = merge[c](o, n) if c in merge else o
        out.append(F.when(matched, changed).when(F.col("o_here").isNotNull(), o).otherwise(n).alias(c))
    action = F.when(matched, "updated").when(F.col("o_here").isNotNull(), "kept").otherwise("inserted")
    return both.select(*out, action.alias("action"))


def replaces(old: Column, new: Column) -> Column:
    return new


def keeps_unless_given(old: Column, new: Column) -> Column:
    return F.coalesce(new, old)


# memories

LIVE_KEY = ("namespace", "content_hash")


def live_keys(memories: DataFrame) -> DataFrame:
    return memories.where(~F.coalesce("is_archived", F.lit(False)) & F.col("content_hash").isNotNull())


def insert_memories(memories: DataFrame, rows: DataFrame, now: datetime) -> DataFrame:
    """All rows added (metadata null as {}, importance null as 3); raises where a live (namespace, content_hash) would repeat."""
    ready = rows.withColumns({"metadata": F.coalesce("metadata", F.lit("{}")), "importance": F.coalesce("importance", F.lit(3)), "created_at": at(now), "updated_at": at(now), "is_archived": F.lit(False)})
    keyed = ready.where(F.col("content_hash").isNotNull())
    clash = keyed.join(live_keys(memories).select(*LIVE_KEY).distinct(), list(LIVE_KEY), "left_semi").select(*LIVE_KEY).unionByName(
        keyed.groupBy(*LIVE_KEY).count().where("count > 1").select(*LIVE_KEY)
    )
    if not clash.isEmpty():
        raise ValueError("a live memory with this namespace and content hash exists")
    return memories.unionByName(ready.select(*memories.columns))


def insert_memories_ignore(memories: DataFrame, rows: DataFrame, order: str = "ord") -> tuple[DataFrame, DataFrame]:
    """(new table, inserted): as many rows as keep live (namespace, content_hash) unique, first come first served."""
    return insert_ignore(memories, rows, LIVE_KEY, order, live_keys)


def upsert_memories(memories: DataFrame, rows: DataFrame, now: datetime, order: str = "ord") -> DataFrame:
    """Content and importance replaced, metadata merged where a live row has the key; new rows else; with ``action``."""
    live = once(live_keys(memories))
    rest = memories.join(live.select("id"), "id", "left_anti")
    merge = {"content": replaces, "importance": replaces, "metadata": lambda o, n: F.to_json(C.merge_metadata(o, n)), "updated_at": lambda o, n: at(now)}
    return upsert(live, rows.select(*memories.columns, order), LIVE_KEY, order, merge).unionByName(rest.withColumn("action", F.lit("kept")))


def update_memories(memories: DataFrame, changes: DataFrame, now: datetime) -> DataFrame:
    """``changes`` (id, content, metadata, importance[, ord]): what is not null replaces; the content hash stays as it is.

    Of several changes of one id the one with the largest ``ord`` counts; without one the largest by its values.
    """
    order = F.col("ord") if "ord" in changes.columns else F.struct("content", "metadata", "importance")
    c = pick_per_key(changes.select("id", "content", "metadata", "importance", order.alias("ord")), ["id"], "ord").select(
        F.col("id").alias("c_id"), F.col("content").alias("c_content"), F.col("metadata").alias("c_metadata"), F.col("importance").alias("c_importance")
    )
    hit = F.col("c_id").isNotNull()
    joined = memories.join(c, F.col("id") == F.col("c_id"), "left")
    return joined.withColumns(
        {
            "content": F.coalesce("c_content", "content"), "metadata": F.coalesce("c_metadata", "metadata"), "importance": F.coalesce("c_importance", "importance"),
            "updated_at": F.when(hit, at(now)).otherwise(F.col("updated_at")),
        }
    ).select(*memories.columns)


def archive(memories: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    """The live memories of ``ids`` archived; archived ones stay as they are."""
    c = ids.select(F.col("id").alias("c_id")).distinct()
    hit = F.col("c_id").isNotNull() & ~F.coalesce("is_archived", F.lit(False))
    return memories.join(c, F.col("id") == F.col("c_id"), "left").withColumns(
        {"updated_at": F.when(hit, at(now)).otherwise(F.col("updated_at")), "is_archived": F.when(hit, True).otherwise(F.col("is_archived"))}
    ).select(*memories.columns)


def _of_user(user_id: str, namespace: str | None) -> Column:
    p = F.coalesce(F.col("user_id") == user_id, F.lit(False))
    return p & F.coalesce(F.col("namespace") == namespace, F.lit(False)) if namespace is not None else p


def forget(memories: DataFrame, user_id: str, namespace: str | None, now: datetime) -> tuple[DataFrame, DataFrame]:
    """(new table, number newly archived): the user's live memories archived."""
    hit = _of_user(user_id, namespace) & ~F.coalesce("is_archived", F.lit(False))
    new = memories.select("*", hit.alias("_hit")).withColumns(
        {"is_archived": F.when(F.col("_hit"), True).otherwise(F.col("is_archived")), "updated_at": F.when(F.col("_hit"), at(now)).otherwise(F.col("updated_at"))}
    ).select(*memories.columns)
    return new, memories.where(hit).agg(F.count_distinct("id").alias("deleted_count"))


def forget_hard(memories: DataFrame, user_id: str, namespace: str | None = None) -> DataFrame:
    return memories.where(~_of_user(user_id, namespace))


def delete_memories(memories: DataFrame, relations: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(memories, relations) without ``ids``: their outgoing relations go, incoming ones lose their target."""
    gone = ids.select(F.col("id").alias("gone_id")).distinct()
    kept = memories.join(gone, F.col("id") == F.col("gone_id"), "left_anti")
    r = relations.join(gone, F.col("source_id") == F.col("gone_id"), "left_anti").join(gone, F.col("target_id") == F.col("gone_id"), "left")
    return kept, r.withColumn("target_id", F.when(F.col("gone_id").isNull(), F.col("target_id"))).select(*relations.columns)


def fill_namespace_ids(memories: DataFrame, namespaces: DataFrame) -> DataFrame:
    """Null namespace ids filled from the registry by name."""
    n = namespaces.groupBy(F.col("uid").alias("n_uid")).agg(F.min("id").alias("n_id"))
    return memories.join(n, F.col("namespace") == F.col("n_uid"), "left").withColumn("namespace_id", F.coalesce("namespace_id", "n_id")).select(*memories.columns)


def ensure_namespaces(namespaces: DataFrame, uids: DataFrame, now: datetime) -> DataFrame:
    """The registry with every ``uid`` in it; new ones get a name made from the uid and an id made from its hash."""
    new = uids.select("uid").where(F.col("uid").isNotNull()).distinct().join(namespaces.select("uid"), "uid", "left_anti")
    h = F.md5("uid")
    made = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return namespaces.unionByName(
        new.select(made.alias("id"), "uid", C.display_name(F.col("uid")).alias("name"), F.lit("").alias("description"), at(now).alias("created_at"), at(now).alias("updated_at"))
    )


# vectors: (id, embedding, user_id, namespace, importance)

def upsert_vectors(vectors: DataFrame, points: DataFrame) -> DataFrame:
    """Whole points replaced by id; points not given stay."""
    return vectors.join(points.select("id"), "id", "left_anti").unionByName(once(points.select(*vectors.columns)))


def update_vectors(vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """Only the embedding replaced, of the ids in ``changes`` (id, embedding)."""
    c = once(changes).select(F.col("id").alias("c_id"), F.col("embedding").alias("c_embedding"))
    return vectors.join(c, F.col("id") == F.col("c_id"), "left").withColumn("embedding", F.coalesce("c_embedding", "embedding")).select(*vectors.columns)


def set_payload(vectors: DataFrame, changes: DataFrame) -> DataFrame:
    """Payload columns replaced where ``changes`` (id and some columns) has a value."""
    given = [c for c in changes.columns if c != "id" and c in vectors.columns]
    c = once(changes).select(F.col("id").alias("c_id"), *[F.col(x).alias(f"c_{x}") for x in given])
    return vectors.join(c, F.col("id") == F.col("c_id"), "left").withColumns({x: F.coalesce(f"c_{x}", x) for x in given}).select(*vectors.columns)


def delete_vectors(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("id").distinct(), "id", "left_anti")


def delete_vectors_of(vectors: DataFrame, user_id: str | None = None, namespace: str | None = None) -> DataFrame:
    """Points that match all given payload values removed; with none given nothing is."""
    if not user_id and not namespace:
        return vectors
    p = F.lit(True)
    for column, value in (("user_id", user_id), ("namespace", namespace)):
        if value:
            p = p & F.coalesce(F.col(column) == value, F.lit(False))
    return vectors.where(~p)
