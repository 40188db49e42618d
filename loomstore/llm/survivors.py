"""Best representative of each duplicate group, by iterative truth discovery over field values.

Every member claims a value for each field (time of change, importance, each metadata key).  Source reliability and
value support are estimated in turn: a value's support is the summed reliability of the members that claim it, a
source's reliability the mean share of support that its claims win.  Times and importance are in order, and every
claim bears out the group's largest one: who says that a record changed in May does not deny a change in June.  So
reliability is estimated from the other fields.
It stops when no reliability moves by more than ``tolerance``.  The survivor takes each metadata key's highest-supported
value and the latest time; the member kept as its base is the one whose claims have the most support over all fields.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.sources.tables import drop_scratch, scratch

MAP = "map<string,string>"
#: Fields whose values are in order.
ORDERED = ("@updated_at", "@importance")


def valued_metadata(column: str = "metadata"):
    """The metadata keys that hold a value (neither null nor ""), as a map to its JSON; null where it is no valid JSON object."""
    parsed = F.try_parse_json(column)
    is_object = F.schema_of_variant(parsed).startswith("OBJECT")
    texts = F.transform_values(F.from_json(column, "map<string,variant>"), lambda k, v: F.to_json(v))
    return F.when(is_object, F.map_filter(texts, lambda k, v: v.isNotNull() & (v != '""') & (v != "null")))


def member_claims(groups: DataFrame, records: DataFrame) -> DataFrame:
    """The members of ``groups`` (id, first_id) with their fields, one row per id.

    ``importance`` is null off the scale 1-5; ``fields`` is null for metadata that is null, empty, cut off or no
    object.  A member without ``user_id`` counts as its own source.
    """
    own = records.select(
        F.col("id"), F.coalesce("user_id", F.concat(F.lit("id:"), F.col("id"))).alias("source_name"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        F.when(F.col("importance").between(1, 5), F.col("importance")).alias("importance"), "metadata",
    )
    joined = groups.select("id", "first_id").join(own, "id").groupBy("first_id", "id").agg(
        F.first("source_name").alias("source_name"), F.first("updated_at").alias("updated_at"), F.first("importance").alias("importance"), F.first("metadata").alias("metadata")
    )
    return joined.select("first_id", "id", "source_name", "updated_at", "importance", valued_metadata().alias("fields"))


def _field_claims(members: DataFrame) -> DataFrame:
    """(first_id, id, source_name, field, value): long form; a member claims nothing for a field it leaves empty."""
    return members.select(
        "first_id", "id", "source_name",
        F.explode(
            F.map_concat(
                F.map_filter(
                    F.create_map(
                        F.lit("@updated_at"), F.col("updated_at").cast("string"), F.lit("@importance"), F.col("importance").cast("string")
                    ),
                    lambda k, v: v.isNotNull(),
                ),
                F.coalesce(F.transform_keys("fields", lambda k, v: F.concat(F.lit("$"), k)), F.expr(f"cast(map() as {MAP})")),
            )
        ).alias("field", "value"),
    )


def _supported(weighed: DataFrame) -> DataFrame:
    """(first_id, field, value, support, total) from votes with their source's reliability.

    In ordered fields all votes support the largest value, as no lower claim denies it; ``total`` is what a field's values have at most.
    """
    own = weighed.groupBy("first_id", "field", "value").agg(F.sum(F.col("votes") * F.col("reliability")).alias("own"))
    field = own.groupBy("first_id", "field").agg(F.sum("own").alias("total"), F.max("value").alias("largest"))
    whole = F.col("field").isin(*ORDERED) & (F.col("value") == F.col("largest"))
    return own.join(field, ["first_id", "field"]).select("first_id", "field", "value", F.when(whole, F.col("total")).otherwise(F.col("own")).alias("support"), "total")


def truth(members: DataFrame, most: int = 200, tolerance: float = 1e-4, damping: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(values, reliability): (first_id, field, value, support, total) of every claimed value, and (source_name, reliability).

    Alternates until no reliability moves by more than ``tolerance``; raises where ``most`` alternations don't get there.  ``damping`` is how many neutral claims each source is
    given, so that a source of few claims stays near one half.  Votes are summed per (group, field, value, source)
    before anything is joined, so that copies of one source in a hot group travel as one row.
    """
    claims = scratch(_field_claims(members).groupBy("first_id", "field", "value", "source_name").agg(F.count(F.lit(1)).alias("votes")), "claims")
    free = claims.where(~F.col("field").isin(*ORDERED))  # no claim of a time or an importance denies another
    trust = claims.groupBy("source_name").agg(F.lit(0.5).alias("reliability"))
    trust = scratch(trust, "trust")
    for _ in range(most):
        share = _supported(free.join(trust, "source_name")).select("first_id", "field", "value", (F.col("support") / F.col("total")).alias("share"))
        told = free.join(share, ["first_id", "field", "value"]).groupBy(F.col("source_name").alias("told_by")).agg(((F.sum(F.col("share") * F.col("votes")) + damping / 2) / (F.sum("votes") + damping)).alias("told"))
        new = trust.join(told, F.col("source_name") == F.col("told_by"), "left").withColumn("now", F.coalesce("told", F.lit(0.5)))
        new = scratch(new.select("source_name", F.col("now").alias("reliability"), F.abs(F.col("now") - F.col("reliability")).alias("moved")), "trust")
        moved = new.agg(F.max("moved")).first()[0]
        drop_scratch(trust)
        trust = new
        if moved is None or moved <= tolerance:
            break
    else:
        raise RuntimeError(f"reliabilities still move by {moved} after {most} rounds")
    values = _supported(claims.join(trust, "source_name"))
    return values, trust.select("source_name", "reliability")


def survivors(groups: DataFrame, records: DataFrame) -> DataFrame:
    """(first_id, best_id, clear, updated_at, importance, metadata): one row per group.

    ``best_id`` is the member to keep: the one whose claims have the largest share of support, summed over the fields;
    a metadata key that it leaves empty counts nothing, one that it fills as a whole field and its share of the key's
    support on top, these shares together as less than a field.  ``clear`` checks of that member that it leaves no
    choice: later than all others, importance on the scale and as high as any, and valid metadata with a value under
    every key for which another has one.  Such a member has the most support whatever the reliabilities are, as each of
    its sums is the largest; in all other groups they decide.  ``updated_at`` is the latest, ``importance`` and each
    metadata key the best-supported value (ties: the larger value), with its JSON type.  Null times count as earliest;
    ties between members go to the smaller id.
    """
    members = scratch(member_claims(groups, records), "claimants")
    values, trust = truth(members)
    values = scratch(values, "values")
    best = values.groupBy("first_id", "field").agg(F.max(F.struct("support", "value")).alias("top"))
    built = best.groupBy("first_id").agg(
        F.max(F.when(F.col("field") == "@importance", F.col("top.value"))).cast("int").alias("importance"),
        F.concat(
            F.lit("{"),
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("field").startswith("$"), F.concat(F.expr("substr(to_json(array(substr(field, 2))), 2, length(to_json(array(substr(field, 2)))) - 2)"), F.lit(":"), F.col("top.value"))))), ","),
            F.lit("}"),
        ).alias("metadata"),
        F.count_if(F.col("field").startswith("$")).alias("all_keys"),
    )
    latest = members.groupBy("first_id").agg(
        F.max("updated_at").alias("top_time"), F.max("importance").alias("top_importance"), F.count(F.lit(1)).alias("n")
    )
    own = _field_claims(members).join(values, ["first_id", "field", "value"])
    share = F.try_divide("support", "total")
    is_key = F.col("field").startswith("$")
    support = own.groupBy("first_id", "id").agg(
        F.sum(F.when(~is_key, share)).alias("ordered"), F.count_if(is_key).alias("n_keys"), F.coalesce(F.sum(F.when(is_key, share)), F.lit(0.0)).alias("shares")
    )
    marked = (
        members.join(latest, "first_id")
        .join(built, "first_id", "left")
        .join(support, ["first_id", "id"], "left")
        .join(trust, "source_name", "left")
        .select(
            "first_id", "id", "top_time", built["importance"].alias("built_importance"), built["metadata"].alias("built_metadata"), "n",
            F.coalesce(members["updated_at"] == F.col("top_time"), F.lit(False)).alias("is_latest"),
            F.coalesce(members["importance"] == F.col("top_importance"), F.lit(False)).alias("is_top"),
            (F.coalesce(F.size("fields"), F.lit(-1)) == F.coalesce("all_keys", F.lit(0))).alias("is_full"),
            (F.coalesce("ordered", F.lit(0.0)) + F.coalesce("n_keys", F.lit(0)) + F.coalesce("shares", F.lit(0.0)) / (F.lit(2.0) * (F.coalesce("all_keys", F.lit(0)) + 1))).alias("support"),
            F.col("fields").isNotNull().alias("is_valid"), F.coalesce("reliability", F.lit(0.5)).alias("reliability"),
        )
        .withColumn("holds_all", F.col("is_latest") & F.col("is_top") & F.col("is_full"))
    )
    rank = F.struct(F.round("support", 9).alias("s"), F.col("is_latest"), F.col("is_top"), F.col("is_valid"), F.round("reliability", 9).alias("r"))
    top = marked.groupBy("first_id").agg(
        F.max(rank).alias("rank"), F.count_if("is_latest").alias("n_latest"), F.first("top_time").alias("updated_at"),
        F.first("built_importance").alias("importance"), F.first("built_metadata").alias("metadata"),
    )
    picked = (
        marked.withColumn("rank_of", rank).join(top, "first_id").where(F.col("rank_of") == F.col("rank"))
        .groupBy("first_id")
        .agg(
            F.min("id").alias("best_id"), F.first(F.col("holds_all") & (F.col("n_latest") == 1)).alias("clear"),
            F.first("updated_at").alias("updated_at"), F.first("importance").alias("importance"), F.first("metadata").alias("metadata"),
        )
    )
    return picked
