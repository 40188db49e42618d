"""Parent-child links of unknown depth: root, depth, path and descendants of every node, with loops found.

The links form a pointer graph (child -> parent).  Some nodes are splitters, chosen by a hash of the id, as is
every root.  Each node first walks to its next splitter; the splitters then form a reduced pointer graph an
order of magnitude smaller, which is solved alone, and one join expands the answer to all nodes.  Both walks
double the pointers, so that k rounds cover 2**k links.  A round in which no pointer arrives proves that the
ones still on the way circle: if an acyclic one were left, the nodes before it on its path would just have arrived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstore.sources.tables import drop_scratch, scratch

#: One node in so many is a splitter.
SPLITTER_RATE = 8


def plain_id(c: Column) -> Column:
    """An id as the tables write it: trimmed, lower case."""
    return F.lower(F.trim(c))


def plain_type(c: Column) -> Column:
    """A link type without differences of case, outer space or ``-`` for ``_``."""
    return F.translate(F.lower(F.trim(c)), "-", "_")


def containment_links(relations: DataFrame, memories: DataFrame) -> DataFrame:
    """(child, parent): the distinct containment links whose two ends are both memories.

    ``contains`` makes the source the parent, ``contained_by`` the target.  Null ends, other link types and ends
    that are no memory take no part.  A child given several parents keeps the smallest, so that each node has one.
    """
    t = plain_type(F.col("link_type"))
    s, e = plain_id(F.col("source_id")), plain_id(F.col("target_id"))
    told = (
        relations.where(t.isin("contains", "contained_by") & F.col("target_id").isNotNull() & F.col("source_id").isNotNull())
        .select(
            F.when(t == "contains", e).otherwise(s).alias("child"),
            F.when(t == "contains", s).otherwise(e).alias("parent"),
        )
        .groupBy("child", "parent")
        .agg(F.lit(1).alias("told"))
    )
    ids = memories.select(plain_id(F.col("id")).alias("node")).where(F.col("node").isNotNull()).distinct()
    both = told.join(ids, F.col("child") == F.col("node"), "left_semi").join(ids, F.col("parent") == F.col("node"), "left_semi")
    return both.groupBy("child").agg(F.min("parent").alias("parent"))


def _splits(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(SPLITTER_RATE)) == 0


def _double(start: DataFrame, name: str, with_path: bool) -> tuple[DataFrame, list[DataFrame]]:
    """Walk every pointer of (node, at, steps[, path], done) until it is done or proved to circle.

    Arrived rows are set aside as they arrive; only the ones on the way are joined again.
    """
    todo, arrived = scratch(start, name), []
    tables = [todo]
    while True:
        counts = {r["done"]: r["n"] for r in todo.groupBy("done").agg(F.count(F.lit(1)).alias("n")).collect()}
        arrived.append(todo.where("done"))
        if not counts.get(False) or (len(arrived) > 1 and not counts.get(True)):
            break
        # a pointer may rest on a node that arrived in any earlier round, so all rounds are looked up
        known = todo.where(~F.col("done"))
        for a in arrived:
            known = known.unionByName(a)
        hop = known.select(
            F.col("node").alias("h_node"), F.col("at").alias("h_at"), F.col("steps").alias("h_steps"), F.col("done").alias("h_done"),
            *([F.col("path").alias("h_path")] if with_path else []),
        )
        path = [F.concat("path", "h_path").alias("path")] if with_path else []
        todo = scratch(
            todo.where(~F.col("done"))
            .join(hop, F.col("at") == F.col("h_node"), "inner")
            .select("node", F.col("h_at").alias("at"), (F.col("steps") + F.col("h_steps")).alias("steps"), F.col("h_done").alias("done"), *path),
            name,
        )
        tables.append(todo)
    out = arrived[0]
    for a in arrived[1:]:
        out = out.unionByName(a)
    return out, tables


def hierarchy(links: DataFrame, with_path: bool = False) -> DataFrame:
    """(node_id, root_id, node_depth[, path]) for every end of ``links`` (child, parent; one parent per child).

    The root has depth 0 and itself as root; ``path`` runs from the root to the node.  A node on a loop (also a
    loop of one) or below one has root '' and depth -1, and an empty path.  Links with a null end are left out;
    no links give no rows.  A child named with several parents must be reduced to one before.
    """
    links = links.where(F.col("child").isNotNull() & F.col("parent").isNotNull()).select("child", "parent")
    links = scratch(links, "links")
    nodes = links.select(F.col("child").alias("node")).union(links.select("parent")).distinct()
    up = nodes.join(links, F.col("node") == F.col("child"), "left").select("node", "parent")

    def made(col: Column) -> list[Column]:
        return [F.array(col).alias("path")] if with_path else []

    # every node's first hop; it is done where that node is a root or a splitter
    roots = up.where(F.col("parent").isNull()).select(F.col("node").alias("root"))
    first = up.where(F.col("parent").isNotNull()).join(roots, F.col("parent") == F.col("root"), "left").select(
        "node", F.col("parent").alias("at"), F.lit(1).alias("steps"),
        (F.col("root").isNotNull() | _splits(F.col("parent"))).alias("done"), F.col("root").isNotNull().alias("at_root"),
        *made(F.col("parent")),
    )
    first = scratch(first, "first")
    walked, t1 = _double(first.drop("at_root"), "walk", with_path)
    walked = scratch(walked, "walked")
    # reduced graph: each splitter that is no root, pointing at its own next splitter; done where that is a root
    is_root = roots.select("root")
    reduced = (
        walked.where(_splits(F.col("node")))
        .join(is_root, F.col("at") == F.col("root"), "left")
        .select("node", "at", "steps", F.col("root").isNotNull().alias("done"), *(["path"] if with_path else []))
    )
    solved, t2 = _double(reduced, "reduced", with_path)
    ends = solved.select(
        F.col("node").alias("s_node"), F.col("at").alias("s_root"), F.col("steps").alias("s_steps"), *([F.col("path").alias("s_path")] if with_path else [])
    ).unionByName(
        roots.select(
            F.col("root").alias("s_node"), F.col("root").alias("s_root"), F.lit(0).alias("s_steps"),
            *([F.expr("cast(array() as array<string>)").alias("s_path")] if with_path else []),
        )
    )
    found = walked.join(ends, F.col("at") == F.col("s_node"), "inner").select(
        F.col("node").alias("f_node"), F.col("s_root").alias("f_root"), (F.col("steps") + F.col("s_steps")).alias("f_depth"),
        *([F.reverse(F.concat(F.array("node"), "path", "s_path")).alias("f_path")] if with_path else []),
    ).unionByName(
        roots.select(F.col("root").alias("f_node"), F.col("root").alias("f_root"), F.lit(0).alias("f_depth"), *([F.array("root").alias("f_path")] if with_path else []))
    )
    out = nodes.join(found, F.col("node") == F.col("f_node"), "left").select(
        F.col("node").alias("node_id"), F.coalesce("f_root", F.lit("")).alias("root_id"), F.coalesce("f_depth", F.lit(-1)).cast("int").alias("node_depth"),
        *([F.coalesce("f_path", F.expr("cast(array() as array<string>)")).alias("path")] if with_path else []),
    )
    result = scratch(out, "hierarchy")
    for t in [*t1, *t2, walked, first, links]:
        drop_scratch(t)
    return result


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) of every node below another, from ``hierarchy(..., with_path=True)``.

    The pairs come from each node's own path, so no join and no group of one ancestor is formed.  Nodes on or below
    a loop have an empty path and no pairs.
    """
    return tree.select("node_id", "node_depth", F.posexplode("path").alias("at", "ancestor_id")).where(F.col("at") < F.col("node_depth")).select(
        "ancestor_id", "node_id", (F.col("node_depth") - F.col("at")).alias("distance")
    )


def descendant_counts(tree: DataFrame) -> DataFrame:
    """(node_id, n_descendants), one row per node of ``tree``; 0 for leaves and for nodes on or below a loop."""
    below = descendants(tree).groupBy("ancestor_id").agg(F.count(F.lit(1)).alias("n"))
    return tree.select("node_id").join(below, F.col("node_id") == F.col("ancestor_id"), "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n_descendants"))
