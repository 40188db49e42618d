"""Queries of the training-data operators by name, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstore.llm import encodings, formats, history, leaks, neighbours, packing, pii, sql, survivors
from loomstore.sources.tables import read_table, scratch


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return history.History.open(read_table(spark, d, "memories"), store=False).known(read_table(spark, d, "memory_inputs"))


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(read_table(spark, d, "dedup_decisions").select(F.col("decision_id").alias("id"), "embedding"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    n = _nearest(spark, d)
    return n.select(F.least("id", "neighbour").alias("decision_a"), F.greatest("id", "neighbour").alias("decision_b")).distinct()


def p2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d).withColumnsRenamed({"id": "decision_id", "neighbour": "neighbour_id"})


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.find(read_table(spark, d, "memories"), redact=False).select(F.col("id").alias("memory_id"), F.explode("kinds").alias("pii_kind"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    """The memories that hold personal information, with typed placeholders in its place."""
    return pii.find(read_table(spark, d, "memories")).selectExpr("id AS memory_id", "array_join(kinds, ',') AS pii_kinds", "redacted")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    g = formats.content_groups(read_table(spark, d, "memories"))
    return g.where("id <> first_id").select("first_id", F.col("id").alias("copy_id"))


def p5_copies(spark: SparkSession, d: str) -> DataFrame:
    """How many contents there are in so many rows and so many spellings."""
    c = formats.content_copies(read_table(spark, d, "memories"))
    return c.groupBy("ns", "n_rows", "n_formats").agg(F.count(F.lit(1)).alias("n_contents"))


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    m = read_table(spark, d, "memories")
    return survivors.survivors(scratch(formats.content_groups(m), "groups"), m)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d).where("clear").select("first_id", "best_id")


def p7_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(read_table(spark, d, "documents"), read_table(spark, d, "context_windows"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p8_containers(spark, d))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(read_table(spark, d, "documents"), read_table(spark, d, "heldout_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p9_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, with the number of documents and the longest passage."""
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("n_words").alias("longest"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return encodings.garbled(read_table(spark, d, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, d: str) -> DataFrame:
    """The garbled documents with the mistakes found and the text as it was."""
    return encodings.garbled(read_table(spark, d, "documents")).selectExpr("doc_id", "array_join(pairs, '; ') AS pairs", "restored")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p4_found": p4_found, "p4_redacted": p4_redacted, "p5_found": p5_found, "p5_copies": p5_copies, "p7_found": p7_found, "p7_survivors": p7_survivors, "p8_containers": p8_containers, "p8_fill": p8_fill, "p9_found": p9_found, "p9_items": p9_items, "p10_found": p10_found, "p10_restored": p10_restored}
SQL: dict = {"p1_found": sql.P1, "p2_found": sql.P2, "p2_neighbours": sql.P2_LISTS, "p5_found": sql.P5, "p5_copies": sql.P5_COPIES, "p7_found": sql.P7}
