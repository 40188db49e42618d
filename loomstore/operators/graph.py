"""The graph of relations: linked and orphaned memories, statistics, traversal.

``relations`` is cleaned by the callers (:func:`loomstore.operators.reads.clean_relations`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.functions.columns import importance_or_default
from loomstore.operators.reads import active, once
from loomstore.sources.tables import drop_scratch, scratch


def linked_ids(relations: DataFrame) -> DataFrame:
    """Every id that is an end of a relation, once; null targets are none."""
    return relations.select(F.explode(F.array("source_id", "target_id")).alias("id")).where(F.col("id").isNotNull()).distinct()


def orphans(memories: DataFrame, relations: DataFrame) -> DataFrame:
    """Live memories that are no end of any relation."""
    return once(active(memories).select("id", "namespace")).join(linked_ids(relations), "id", "left_anti")


def _marked(memories: DataFrame, relations: DataFrame) -> DataFrame:
    linked = linked_ids(relations).withColumn("is_linked", F.lit(True))
    return once(active(memories).select("id", "namespace")).join(linked, "id", "left").withColumn("is_linked", F.coalesce("is_linked", F.lit(False)))


def stats_cte(memories: DataFrame, relations: DataFrame) -> DataFrame:
    """Totals in which every linked id counts, also of archived or missing memories."""
    m = _marked(memories, relations).agg(F.count(F.lit(1)).alias("total_granules"), F.count_if(~F.col("is_linked")).alias("orphans"))
    r = relations.agg(F.count(F.lit(1)).alias("total_relations"))
    ids = linked_ids(relations).agg(F.count(F.lit(1)).alias("linked_granules"))
    return m.crossJoin(r).crossJoin(ids).select("total_granules", "total_relations", "linked_granules", "orphans")


def stats_unified(memories: DataFrame, relations: DataFrame) -> DataFrame:
    """Totals in which only live linked memories count, and the mean number of relations (both ends) per memory."""
    m = _marked(memories, relations).agg(
        F.count(F.lit(1)).alias("total_granules"), F.count_if("is_linked").alias("linked_granules"), F.count_if(~F.col("is_linked")).alias("orphans")
    )
    r = relations.agg(F.count(F.lit(1)).alias("total_relations"))
    mean = F.when(F.col("total_granules") > 0, F.round(2.0 * F.col("total_relations") / F.col("total_granules"), 2)).otherwise(0.0)
    return m.crossJoin(r).select("total_granules", "total_relations", "linked_granules", "orphans", mean.alias("avg_connections"))


def stats_by_namespace(memories: DataFrame, relations: DataFrame) -> DataFrame:
    return _marked(memories, relations).groupBy("namespace").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_linked").alias("linked"), F.count_if(~F.col("is_linked")).alias("orphans")
    ).orderBy("namespace")


def stats_by_link_type(relations: DataFrame) -> DataFrame:
    return relations.groupBy("link_type").agg(F.count(F.lit(1)).alias("cnt")).orderBy(F.desc("cnt"), "link_type")


def stats_json(memories: DataFrame, relations: DataFrame) -> DataFrame:
    """One row: totals, by_namespace and by_link_type as JSON objects, keys in order; empty objects where there are none.

    The inputs of the JSON are one row per namespace and link type.
    """
    ns = stats_by_namespace(memories, relations).groupBy().agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("namespace", F.lit("")), F.struct("total", "linked", "orphans")))))).alias("by_namespace")
    )
    lt = stats_by_link_type(relations).groupBy().agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.coalesce("link_type", F.lit("")), "cnt"))))).alias("by_link_type")
    )
    return stats_unified(memories, relations).crossJoin(ns).crossJoin(lt)


def _edges(relations: DataFrame, link_types: Sequence[str] | None) -> DataFrame:
    e = relations.where(F.col("target_id").isNotNull() & F.col("source_id").isNotNull())
    if link_types:
        e = e.where(F.col("link_type").isin(list(link_types)))
    return e.select("source_id", "target_id").distinct()


def walk(relations: DataFrame, start_id: str, depth: int = 3, link_types: Sequence[str] | None = None) -> DataFrame:
    """(node_id, depth): every node at every depth at which a path without repeats reaches it.

    The paths are kept, so this is for shallow depths; :func:`reachable` has each node's least depth for any depth.
    """
    edges = _edges(relations, link_types)
    spark = relations.sparkSession
    front = spark.createDataFrame([(start_id, 0, [start_id])], "node_id string, depth int, path array<string>")
    steps = [front]
    for _ in range(depth):
        front = (
            front.join(edges, F.col("node_id") == F.col("source_id"))
            .where(~F.array_contains("path", F.col("target_id")))
            .select(F.col("target_id").alias("node_id"), (F.col("depth") + 1).alias("depth"), F.concat("path", F.array("target_id")).alias("path"))
        )
        steps.append(front)
    out = steps[0]
    for s in steps[1:]:
        out = out.unionByName(s)
    return out.select("node_id", "depth").distinct().orderBy("depth", "node_id")


def reachable(relations: DataFrame, start_id: str, depth: int = 3, link_types: Sequence[str] | None = None) -> DataFrame:
    """(node_id, depth): each node within ``depth`` steps at its least depth; visited nodes are joined out of each frontier.

    A shortest path repeats no node, so the depth is the same as the least of :func:`walk`.  The edges are written once,
    as is every frontier, so plans stay flat however deep the walk goes; all but the frontiers are dropped at the end.
    """
    edges = scratch(_edges(relations, link_types), "edges", ["source_id"])
    spark = relations.sparkSession
    seen = scratch(spark.createDataFrame([(start_id, 0)], "node_id string, depth int"), "seen")
    front = seen
    for d in range(1, depth + 1):
        new = (
            edges.join(front.select(F.col("node_id").alias("source_id")), "source_id", "left_semi").select(F.col("target_id").alias("node_id")).distinct()
            .join(seen.select("node_id"), "node_id", "left_anti").select("node_id", F.lit(d).alias("depth"))
        )
        front = scratch(new, "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    drop_scratch(edges)
    return seen


def traverse_nodes(memories: DataFrame, relations: DataFrame, start_id: str, depth: int = 3, link_types: Sequence[str] | None = None, at: DataFrame | None = None) -> DataFrame:
    """The memories that the walk reaches, archived or not, at their least depth, with 200 characters of content.

    ``at`` is a walk (node_id, depth) done before.
    """
    at = reachable(relations, start_id, depth, link_types) if at is None else at
    m = once(memories.select("id", F.left("content", F.lit(200)).alias("content"), "namespace", "importance").join(at.select(F.col("node_id").alias("id")), "id", "left_semi"))
    return at.join(m, at["node_id"] == m["id"]).select("id", "content", "namespace", importance_or_default(F.col("importance")).cast("int").alias("importance"), "depth")


def traverse_edges(relations: DataFrame, start_id: str, depth: int = 3, link_types: Sequence[str] | None = None, at: DataFrame | None = None) -> DataFrame:
    """All relations, of any type, between the nodes that the walk reaches; ``at`` is a walk done before."""
    at = (reachable(relations, start_id, depth, link_types) if at is None else at).select("node_id")
    r = relations.select("id", "source_id", "target_id", "link_type", "description", "weight")
    return r.join(at, F.col("source_id") == F.col("node_id"), "left_semi").join(at, F.col("target_id") == F.col("node_id"), "left_semi")


def link_type_share(relations: DataFrame) -> DataFrame:
    """The share of each link type in all relations, in percent."""
    by = relations.groupBy("link_type").agg(F.count(F.lit(1)).alias("cnt"))
    total = by.agg(F.sum("cnt").alias("total"))
    return by.crossJoin(F.broadcast(total)).select("link_type", "cnt", F.round(100.0 * F.col("cnt") / F.col("total"), 2).alias("pct"))


def policy_violations(memories: DataFrame, relations: DataFrame, allowed: DataFrame) -> DataFrame:
    """Relations between two namespaces whose link type ``allowed`` (source_ns, target_ns, link_type) doesn't list.

    Ends of the same namespace, and ends that are no memory, are never violations.
    """
    m = once(memories.select("id", "namespace"))
    r = (
        relations.select("id", "source_id", "target_id", "link_type")
        .join(m.select(F.col("id").alias("source_id"), F.col("namespace").alias("source_ns")), "source_id")
        .join(m.select(F.col("id").alias("target_id"), F.col("namespace").alias("target_ns")), "target_id")
        .where(F.col("source_ns") != F.col("target_ns"))
    )
    return r.join(allowed.select("source_ns", "target_ns", "link_type").distinct(), ["source_ns", "target_ns", "link_type"], "left_anti").select("id", "source_ns", "target_ns", "link_type")
