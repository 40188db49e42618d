"""Duplicates hidden by formatting: byte-identical rows first, canonical forms of the survivors next.

Byte-identical contents are collapsed with their counts before any text work.  Only the distinct survivors are
canonicalised, and grouped again on their full canonical text (as its SHA-256, so that no text is shuffled twice),
summing the counts.  Both groupings pre-aggregate in the map tasks, so a group that holds a third of all rows
reaches the reducers as one row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore.llm.texts import canonical, digest
from loomstore.sources.tables import scratch

#: Namespace of rows that name none.
NO_NAMESPACE = "default"


def _canonical_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        digests = [digest(canonical(t)) for t in b.column("content").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("ns"), b.column("raw"), pa.array(digests, pa.binary()), b.column("n_rows")], names=["ns", "raw", "canon", "n_rows"]
        )


def canonical_contents(records: DataFrame) -> DataFrame:
    """(ns, raw, canon, n_rows): each distinct (namespace, content) with the digest of its canonical text.

    ``records`` needs ``content`` and ``namespace``; a null namespace reads as ``default``; null contents are left
    out; an empty content is one like any other (its canonical text is empty).
    """
    raw = (
        records.where(F.col("content").isNotNull())
        .groupBy(F.coalesce("namespace", F.lit(NO_NAMESPACE)).alias("ns"), "content")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .select("ns", "content", F.unhex(F.sha2("content", 256)).alias("raw"), "n_rows")
    )
    return raw.mapInArrow(_canonical_batches, "ns string, raw binary, canon binary, n_rows long")


def content_copies(records: DataFrame) -> DataFrame:
    """(ns, canon, n_rows, n_formats): one row per content with how many rows and spellings it had."""
    return canonical_contents(records).groupBy("ns", "canon").agg(F.sum("n_rows").alias("n_rows"), F.count(F.lit(1)).alias("n_formats"))


def content_groups(records: DataFrame) -> DataFrame:
    """(id, first_id, n_copies): the members of every group of two or more distinct ids with one content.

    Rows repeated under one id are one record.  The member rows carry ids and digests only; a hot group is joined to
    its one canonical row, which adaptive execution splits.  Null ids are left out; no groups give no rows.
    """
    canon = canonical_contents(records)
    ids = records.where(F.col("content").isNotNull() & F.col("id").isNotNull()).select(
        "id", F.coalesce("namespace", F.lit(NO_NAMESPACE)).alias("ns"), F.unhex(F.sha2("content", 256)).alias("raw")
    )
    members = ids.join(canon.select("ns", "raw", "canon"), ["ns", "raw"]).groupBy("ns", "canon", "id").agg(F.lit(1).alias("one"))
    members = scratch(members.select("ns", "canon", "id"), "members")
    groups = members.groupBy("ns", "canon").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")
    return members.join(groups, ["ns", "canon"]).select("id", "first_id", "n_copies")
