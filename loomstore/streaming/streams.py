"""Structured Streaming variants of the stateful operators.

Sources read with an explicit schema; event times are cast to TIMESTAMP, which watermarks need.  Each has a batch twin
among the operators; in complete or update mode over all input they give the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from loomstore.functions import columns as C
from loomstore.operators import dedup
from loomstore.sources.tables import drop_scratch, scratch, shared_folder

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(folder)


def run_once(stream: DataFrame, name: str, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """Everything there is, then stop: the rows of all micro-batches (of the last one in complete mode), or each batch through ``each``.

    Every run starts anew, with a checkpoint and a folder of its own.  Rows go from the executors to the shared folder,
    none through the driver; a micro-batch that is tried again replaces what it wrote.
    """
    spark, own = stream.sparkSession, f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/rows-{own}"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(path if mode == "complete" else f"{path}/batch-{n}")

    w = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{shared_folder(spark)}/stream-{own}")
    w.foreachBatch(each or keep).start().awaitTermination()
    if each:
        return None
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def first_contents(stream: DataFrame, ts: str = "arrived_at", late: str | None = None) -> DataFrame:
    """The first entry of each (namespace, content): exact dedup of a stream; ``late`` bounds the state by a watermark."""
    keyed = stream.where(F.col("content").isNotNull()).withColumns({"namespace": F.coalesce("namespace", F.lit("default")), "own_hash": C.sha256(F.col("content")), "event_time": F.col(ts).cast("timestamp")})
    if late:
        return keyed.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["namespace", "own_hash"])
    return keyed.dropDuplicates(["namespace", "own_hash"])  # exact over all time: the state holds two short keys per content


def store_loop(stream: DataFrame, store: dict[str, DataFrame], now: datetime, take: Callable[[DataFrame, int], None]) -> dict[str, DataFrame]:
    """Each micro-batch taken in by :func:`loomstore.operators.dedup.ingest`; ``take`` gets its results; the grown store is returned.

    ``store`` has memories, relations and namespaces.  A batch is judged against the store that the batches before it
    left, which is written to the shared folder each time, so the result depends on the order of arrival, as it does for
    single calls.
    """
    state = dict(store)

    def each(batch: DataFrame, n: int) -> None:
        batch = scratch(batch, "micro-batch")
        out = dedup.ingest(batch, state["memories"], state["relations"], state["namespaces"], now)
        new = {k: scratch(out[k], k) for k in ("memories", "relations", "namespaces")}
        take(out["results"], n)
        for k, df in new.items():
            drop_scratch(state[k])
            state[k] = df

    run_once(stream, "store-loop", each=each)
    return state


HASH_STATE = "content_hash string, size_bytes long, created_us long, updated_us long"
HASH_OUT = "source_type string, source_id string, content_hash string, size_bytes long, created_us long, updated_us long"


class LastHash(StatefulProcessor):
    """Last values per resource; ``updated_us`` moves only when the hash does.  A resource that isn't told for ``ttl_ms`` is forgotten."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", HASH_STATE, ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        held = self.state.get() if self.state.exists() else None
        batch = pd.concat(list(rows)).sort_values(["ts_us", "ord"])
        last = list(held) if held else None
        for h, n, t in zip(batch["content_hash"], batch["size_bytes"], batch["ts_us"]):
            if last is None:
                last = [h, int(n), int(t), int(t)]
            else:
                last = [h, int(n), last[2], last[3] if h == last[0] else int(t)]
        self.state.update(tuple(last))
        yield pd.DataFrame([[*key, *last]], columns=[c.split()[0] for c in HASH_OUT.split(", ")])

    def close(self) -> None:
        pass


def last_hashes(stream: DataFrame, ttl_days: int | None = None) -> DataFrame:
    """The registry of resource hashes as keyed state over (source_type, source_id, content_hash, size_bytes, ts_us, ord), in update mode.

    State is kept for ``ttl_days`` of processing time after a resource was last told.  None keeps it for good, one short
    row a resource, and is for runs that end: state that expires asks for batches without data, which never do.
    """
    return stream.groupBy("source_type", "source_id").transformWithStateInPandas(statefulProcessor=LastHash(ttl_days and ttl_days * 86_400_000), outputStructType=HASH_OUT, outputMode="Update", timeMode="ProcessingTime" if ttl_days else "None")


class CacheEntry(StatefulProcessor):
    """Hits and misses of one key: an entry is made by a miss and lives for ``ttl_us`` of event time."""

    def __init__(self, ttl_us: int, forget: bool):
        self.ttl_us, self.forget = ttl_us, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        # an entry that nobody asks for outlives its time in the cache by a day of processing time at most
        self.state = handle.getValueState("made", "us long", ttlDurationMs=self.ttl_us // 1000 + 86_400_000 if self.forget else None)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        made = self.state.get()[0] if self.state.exists() else None
        hits = misses = 0
        for t in sorted(int(t) for r in rows for t in r["ts_us"]):
            if made is not None and t - made < self.ttl_us:
                hits += 1
            else:
                made, misses = t, misses + 1
        self.state.update((made,))
        yield pd.DataFrame({"key": [key[0]], "hits": [hits], "misses": [misses]})

    def close(self) -> None:
        pass


def cache_hits(stream: DataFrame, key: str, ts: str, ttl_s: int = 86_400, forget: bool = False) -> DataFrame:
    """Hits and misses per key and micro-batch of a cache whose entries live for ``ttl_s`` after they are made (update mode).

    ``forget`` lets the state of entries that nobody asks for expire; it is for streams that run on, as in :func:`last_hashes`.
    """
    timed = stream.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("ts_us"))
    return timed.groupBy("key").transformWithStateInPandas(statefulProcessor=CacheEntry(ttl_s * 1_000_000, forget), outputStructType="key string, hits long, misses long", outputMode="Update", timeMode="ProcessingTime" if forget else "None")


def running_ratio(decided: DataFrame) -> DataFrame:
    """Running share of entries not inserted, per namespace (update or complete mode)."""
    return decided.groupBy("namespace").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("action") != "insert") / F.count(F.lit(1))).alias("dedup_ratio"))


def tumbling(stream: DataFrame, ts: str, width: str, by: list[str], late: str = "1 hour") -> DataFrame:
    """Counts per window and key with a watermark."""
    return stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late).groupBy(F.window("event_time", width), *by).agg(F.count(F.lit(1)).alias("n"))


def sliding(stream: DataFrame, ts: str, width: str, step: str, by: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late).groupBy(F.window("event_time", width, step), *by).agg(F.count(F.lit(1)).alias("n"))


def sessions(stream: DataFrame, ts: str, gap: str, by: list[str], late: str = "1 hour") -> DataFrame:
    return stream.withColumn("event_time", F.col(ts).cast("timestamp")).withWatermark("event_time", late).groupBy(F.session_window("event_time", gap), *by).agg(F.count(F.lit(1)).alias("n"))


def since(spark: SparkSession, folder: str, mark: datetime, column: str = "created_at") -> DataFrame:
    """Incremental read: the rows of a folder after a high-water mark."""
    return spark.read.parquet(folder).where(F.col(column) > F.lit(mark).cast("timestamp_ntz"))
