"""References to records that do not exist, kept as incremental state per key.

The state has two tables: the parent index (per key the earliest time from which some live parent has it) and the
references told so far.  A batch brings new references, arriving parents and deletions.  New references probe the
index; arriving parents may resolve references that wait as orphans; deletions take a parent's key away again and
reopen what it had resolved.  Only references whose key was touched by the batch are looked at again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstore.functions.columns import plain_name
from loomstore.sources.tables import drop_scratch, scratch

PARENT = "kind string, ref_key string, parent_id string, since timestamp_ntz"


def plain_id(c: Column) -> Column:
    """An id without regard to letter case."""
    return F.lower(c)


def name_key(c: Column) -> Column:
    """An entity name as names are compared."""
    return plain_name(c)


def _reference(field: str, kind: str, key: Column, used: Column) -> Column:
    return F.struct(F.lit(field).alias("ref_field"), F.lit(kind).alias("kind"), key.alias("ref_key"), used.alias("used"))


def reference_rows(relations: DataFrame) -> DataFrame:
    """(relation_id, ref_field, kind, ref_key, told_at): each reference a relation makes, repeated deliveries once.

    ``source_id`` always refers (a null one matches nothing and is an orphan), ``target_id`` where it is not null,
    ``target_name`` only where ``target_id`` is null and the name is not.
    """
    once = relations.select("id", "source_id", "target_id", "target_name", "created_at")
    refs = once.select(
        plain_id(F.col("id")).alias("relation_id"),
        F.col("created_at").cast("timestamp_ntz").alias("told_at"),
        F.inline(
            F.array(
                _reference("source_id", "id", plain_id(F.col("source_id")), F.lit(True)),
                _reference("target_id", "id", plain_id(F.col("target_id")), F.col("target_id").isNotNull()),
                _reference("target_name", "name", name_key(F.col("target_name")), F.col("target_id").isNull() & F.col("target_name").isNotNull()),
            )
        ),
    )
    return refs.where("used").drop("used").groupBy("relation_id", "ref_field").agg(
        F.first("kind").alias("kind"), F.first("ref_key").alias("ref_key"), F.min("told_at").alias("told_at")
    )


def parent_rows(memories: DataFrame, names: bool = True) -> DataFrame:
    """(kind, ref_key, parent_id, since): the keys under which each memory can be referred to, repeats included.

    A memory has its id and, where its metadata is valid JSON with a non-null ``entity_name``, that name.  A broken
    text never has one: it is parsed strictly and as a whole.
    """
    named = F.when(F.col("metadata").contains("entity_name"), F.try_variant_get(F.try_parse_json("metadata"), "$.entity_name", "string"))
    keys = F.array(
        F.struct(F.lit("id").alias("kind"), plain_id(F.col("id")).alias("ref_key")),
        *([F.struct(F.lit("name").alias("kind"), name_key(named).alias("ref_key"))] if names else []),
    )
    return memories.select(plain_id(F.col("id")).alias("parent_id"), F.col("created_at").cast("timestamp_ntz").alias("since"), F.inline(keys)).where(
        F.col("ref_key").isNotNull()
    ).select("kind", "ref_key", "parent_id", "since")


@dataclass
class OrphanState:
    """parents: one row per key and parent; refs: every reference with ``orphan``, whether it waits for a parent."""

    parents: DataFrame
    refs: DataFrame
    is_empty: bool = False

    @classmethod
    def empty(cls, spark) -> "OrphanState":
        return cls(
            spark.createDataFrame([], PARENT),
            spark.createDataFrame([], "relation_id string, ref_field string, kind string, ref_key string, told_at timestamp_ntz, orphan boolean"), True,
        )


def _probe(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """``refs`` with ``orphan``: true where no parent of the key was there when the reference was told.

    The index is reduced to one row per key first, so a key that many parents or references share joins 1 : n.
    """
    index = parents.groupBy(F.col("kind").alias("p_kind"), F.col("ref_key").alias("p_key")).agg(F.min("since").alias("p_since"))
    return refs.join(index, (F.col("kind") == F.col("p_kind")) & (F.col("ref_key") == F.col("p_key")), "left").select(
        "relation_id", "ref_field", "kind", "ref_key", "told_at", (~F.coalesce(F.col("p_since") <= F.col("told_at"), F.lit(False))).alias("orphan")
    )


def advance(state: OrphanState, new_refs: DataFrame | None = None, arrived: DataFrame | None = None, deleted: DataFrame | None = None) -> OrphanState:
    """The state after one batch; what the batch changes is written to the shared folder, the state before stays as it is.

    ``new_refs`` as of :func:`reference_rows`, ``arrived`` as of :func:`parent_rows`, ``deleted`` has ``parent_id``.
    New parents are appended, so a batch of arrivals rewrites no parent; deletions are kept as a list that takes the
    parents away.  An arriving parent can only resolve references that wait as orphans, and a deletion can only reopen
    references that don't: only those whose key the batch touched are probed again.  A reference that is told again
    replaces nothing; a parent that arrives again stays one parent.  Nulls match nothing.  A batch can be run again from
    the state before it; a caller that is done with a state calls :func:`forget`.
    """
    parents, refs = state.parents, state.refs
    on = (F.col("kind") == F.col("t_kind")) & (F.col("ref_key") == F.col("t_key"))
    touched = None

    def keys(rows: DataFrame, reopens: bool) -> DataFrame:
        return rows.select(F.col("kind").alias("t_kind"), F.col("ref_key").alias("t_key")).distinct().withColumn("t_reopens", F.lit(reopens))

    if arrived is not None:
        new = scratch(arrived.select("kind", "ref_key", "parent_id", "since"), "parents", ["kind", "ref_key"])
        touched = keys(new, False)
        parents = parents.unionByName(new)
    if deleted is not None:
        gone = scratch(deleted.select(F.col("parent_id").alias("gone_id")).where(F.col("gone_id").isNotNull()).distinct(), "gone")
        lost = keys(parents.join(gone, F.col("parent_id") == F.col("gone_id"), "left_semi"), True)
        touched = lost if touched is None else touched.unionByName(lost)
        parents = parents.join(gone, F.col("parent_id") == F.col("gone_id"), "left_anti")
    kept, probe = refs, None
    if touched is not None:
        # a key may be touched in both ways; a reference is looked at again where one of them can change it
        marks = touched.groupBy("t_kind", "t_key").agg(F.bool_or("t_reopens").alias("reopens"), F.bool_or(~F.col("t_reopens")).alias("resolves"))
        again = F.coalesce((F.col("orphan") & F.col("resolves")) | (~F.col("orphan") & F.col("reopens")), F.lit(False))
        marked = refs.join(marks, on, "left").withColumn("again", again)
        kept = marked.where(~F.col("again")).select(*refs.columns)
        probe = marked.where("again").select("relation_id", "ref_field", "kind", "ref_key", "told_at")
    if new_refs is not None:
        fresh = new_refs.select("relation_id", "ref_field", "kind", "ref_key", "told_at")
        if not state.is_empty:
            fresh = fresh.join(refs.select("relation_id", "ref_field"), ["relation_id", "ref_field"], "left_anti")
        probe = fresh if probe is None else probe.unionByName(fresh)
    if probe is None:
        return OrphanState(parents, refs, state.is_empty)
    asked = scratch(probe, "probe")
    wanted = parents.join(keys(asked, False).select("t_kind", "t_key"), on, "left_semi")
    return OrphanState(parents, scratch(kept.unionByName(_probe(asked, wanted)), "refs"), False)


def forget(state: OrphanState) -> None:
    """Remove the references of a state whose successor is kept; its parents are part of the successor's."""
    drop_scratch(state.refs)


def orphan_references(relations: DataFrame, memories: DataFrame) -> DataFrame:
    """(relation_id, ref_field, told_at): references without a match, from two batches of the state.

    First everything arrives and the references probe; then the archived memories are deleted and reopen theirs.
    A match is not archived and was created no later than the link; a null time of either matches nothing; a null
    ``is_archived`` counts as live.
    """
    refs = reference_rows(relations)
    first = advance(OrphanState.empty(relations.sparkSession), refs, parent_rows(memories))
    gone = memories.where("is_archived").select(plain_id(F.col("id")).alias("parent_id"))
    last = advance(first, deleted=gone)
    forget(first)
    return last.refs.where("orphan").select("relation_id", "ref_field", "told_at")


def orphan_counts(orphans: DataFrame, table: str = "relations") -> DataFrame:
    """Snapshot: (table_name, ref_field, month, n_orphans) per field and month of the link; a null month stays null."""
    return orphans.groupBy(F.lit(table).alias("table_name"), "ref_field", F.date_format("told_at", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n_orphans")
    )
