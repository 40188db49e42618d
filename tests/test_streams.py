"""Streams over files give what their batch twins give."""

from datetime import datetime

from pyspark.sql import functions as F

from loomstore.operators import hashes
from loomstore.plans.analysis import hash_log
from loomstore.sources.tables import read_table
from loomstore.streaming import streams
from tests.conftest import rows


def test_hash_state_is_the_fold(spark, sf, tmp_path):
    log = hash_log(spark, sf)
    folder = str(tmp_path / "log")
    us = log.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))
    us.repartitionByRange(3, "ts").sortWithinPartitions("ts").write.parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    out = streams.last_hashes(streams.source(spark, folder, us.schema))
    last = streams.run_once(out, "hashes_t", "update").groupBy("source_type", "source_id").agg(F.max_by("content_hash", "updated_us").alias("content_hash"), F.max("updated_us").alias("u"))
    want = hashes.fold(log).select("source_type", "source_id", "content_hash", F.unix_micros(F.col("updated_at").cast("timestamp")).alias("u"))
    assert rows(last) == rows(want)


def test_store_loop_sees_the_batches_before(spark, sf, tmp_path):
    """Equal entries in two micro-batches: inserted once; the decisions of all batches are those of single ingests in turn."""
    from loomstore.operators import dedup, reads
    from loomstore.plans.memory import memories, relations

    folder = tmp_path / "in"
    inputs = read_table(spark, sf, "memory_inputs").select(F.col("input_id").alias("ord"), "user_id", "content", "metadata", "namespace", "importance").where("ord <= 12")
    again = inputs.withColumn("ord", F.col("ord") + 1000)
    inputs.coalesce(1).write.parquet(str(folder / "a"))
    again.coalesce(1).write.parquet(str(folder / "b"))
    r = spark.readStream.schema(inputs.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
    store = {"memories": reads.once(memories(spark, sf)), "relations": relations(spark, sf), "namespaces": read_table(spark, sf, "memory_namespaces")}
    got, now = [], datetime(2026, 6, 1)
    grown = streams.store_loop(r, store, now, lambda d, n: got.append(rows(d, "ord", "action", "id")))
    assert len(got) == 2
    first, second = sorted(got)
    one = dedup.ingest(inputs, store["memories"], store["relations"], store["namespaces"], now)
    assert {a for _, a, _ in first} >= {"insert"} and "insert" not in {a for _, a, _ in second}
    assert rows(one["results"], "ord", "action", "id") in (first, [(o - 1000, a, i) for o, a, i in first])
    assert grown["memories"].count() == one["memories"].count()


def test_cache_ttl(spark, sf):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", streams.ROCKS)
    e = read_table(spark, sf, "events")
    r = spark.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    got = streams.run_once(streams.cache_hits(r, "event_type", "ts", 3600 * 24 * 365), "cache_t", "update").agg(F.sum("hits"), F.sum("misses")).first()
    n = e.select("event_type").distinct().count()
    assert tuple(got) == (e.count() - n, n)


def test_high_water_mark(spark, sf):
    assert streams.since(spark, f"{sf}/memories.parquet", datetime(2100, 1, 1)).count() == 0


def test_rows_of_a_stream_stay_off_the_driver(spark, tmp_path):
    """Every mode's rows are read back from files; complete mode gives the last batch, the others all of them."""
    folder = str(tmp_path / "in")
    spark.sql("SELECT id, timestamp'2026-01-01' + make_interval(0, 0, 0, 0, id) AS ts, id % 3 AS k FROM range(30)").repartition(3).write.parquet(folder)
    schema = spark.read.parquet(folder).schema
    r = streams.source(spark, folder, schema, files_per_trigger=1)
    n = streams.run_once(streams.sessions(r, "ts", "2 hours", ["k"], late="9 days"), "sessions_t", "complete")
    assert n.inputFiles() and rows(n, "k", "n") == [(k, 1) for k in range(3) for _ in range(10)]
    every = streams.run_once(r.select("id"), "rows_t")
    assert every.inputFiles() and rows(every) == sorted(((i,) for i in range(30)), key=lambda x: str(x[0]))
    (tmp_path / "none").mkdir()
    assert streams.run_once(streams.source(spark, str(tmp_path / "none"), schema), "none_t").count() == 0
