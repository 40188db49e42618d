"""Vector and full-text search.

``vectors`` is (id, embedding, user_id, namespace, importance).  Payload filters run before any scoring; an empty text
means no filter, as does None.  Scores are cosines rounded to six decimals; ties go to the smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstore.functions import columns as C
from loomstore.operators.reads import active, once

#: Queries of one block that is sent to the executors.
QUERY_BLOCK = 4096
#: Probability with which a pair at the threshold meets in some signature; signatures of a vector and planes of one, at most.
RECALL, MOST_TABLES, MOST_BITS = 0.95, 64, 16


def payload_filter(vectors: DataFrame, user_id: str | None = None, namespace: str | None = None) -> DataFrame:
    for column, value in (("user_id", user_id), ("namespace", namespace)):
        if value:
            vectors = vectors.where(F.col(column) == value)
    return vectors


def top_k(vectors: DataFrame, query: list[float], k: int = 10, threshold: float | None = 0.7, user_id: str | None = None, namespace: str | None = None) -> DataFrame:
    """(id, score) of the k best for one query; unusable vectors (null, other length, zero) score null and are left out."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = payload_filter(vectors, user_id, namespace).where(F.size("embedding") == len(query)).select("id", C.cosine(F.col("embedding"), q).alias("raw"))
    if threshold is not None:
        scored = scored.where(F.col("raw") >= threshold)
    return scored.where(F.col("raw").isNotNull()).select("id", F.round("raw", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def hydrate(hits: DataFrame, memories: DataFrame) -> DataFrame:
    """Hits with their live memories, in the order of the hits; missing and archived ones drop out."""
    m = once(active(memories).join(hits.select("id"), "id", "left_semi").select("id", "content", "metadata", "namespace", "importance"))
    return hits.join(m, "id").select("id", "content", "metadata", "namespace", "importance", "score").orderBy(F.desc("score"), "id")


def _block_scores(queries: pa.Table, k: int, threshold: float | None):
    """Per block of vectors one matrix product with all queries; only each query's best of the block go on."""
    ids = queries.column("query_id").to_pylist()
    q = np.array(queries.column("embedding").to_pylist(), dtype=np.float64).reshape(len(ids), -1)
    q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column("id").to_pylist()
            if not own:
                continue
            v = np.array(b.column("embedding").to_pylist(), dtype=np.float64)
            n = np.linalg.norm(v, axis=1)
            s = q @ (v / np.maximum(n, 1e-300)[:, None]).T
            s[:, n == 0] = -2.0
            low = -1.5 if threshold is None else threshold
            out: tuple[list, list, list] = ([], [], [])
            order = np.argsort(own, kind="stable")
            s, names = s[:, order], [own[i] for i in order]
            r = np.round(s, 6)
            for i, x in enumerate(ids):
                good = np.flatnonzero(s[i] >= low)
                if len(good) > k:
                    good = good[np.argsort(-r[i][good], kind="stable")[:k]]
                out[0].extend([x] * len(good))
                out[1].extend(names[j] for j in good)
                out[2].extend(r[i][good].tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.float64())], names=["query_id", "id", "score"])

    return run


def top_k_batch(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float | None = None) -> DataFrame:
    """(query_id, id, score): the k best for every query (query_id, embedding of one length), itself included.

    The queries are the stated set; they go out in blocks of ``QUERY_BLOCK`` and the vectors are never shuffled: each
    task sends on at most k hits a query and batch.
    """
    rows = queries.where(F.col("embedding").isNotNull()).select(F.col("query_id").cast("string").alias("query_id"), "embedding")
    size = rows.select(F.max(F.size("embedding"))).first()[0]
    if size is None:
        return queries.sparkSession.createDataFrame([], "query_id string, id string, score double")
    rows = rows.where(F.size("embedding") == size)
    points = vectors.where(F.size("embedding") == size).select(F.col("id").cast("string").alias("id"), "embedding")
    total = rows.count()
    hits = None
    for part in range(-(-total // QUERY_BLOCK)):
        own = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(-(-total // QUERY_BLOCK))) == part).toArrow()
        if own.num_rows:
            got = points.mapInArrow(_block_scores(own, k, threshold), "query_id string, id string, score double")
            hits = got if hits is None else hits.unionByName(got)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def lsh_shape(threshold: float, recall: float = RECALL, most: int = MOST_TABLES) -> tuple[int, int]:
    """(tables, bits): the most planes a signature with which ``most`` tables let a pair of cosine ``threshold`` (over 0) meet with probability ``recall``."""
    same = 1 - math.acos(min(threshold, 1.0)) / math.pi
    for bits in range(MOST_BITS, 0, -1):
        tables = 1 if same == 1 else math.ceil(math.log(1 - recall) / math.log(1 - same**bits))
        if tables <= most:
            break
    return tables, bits


def top_k_lsh(vectors: DataFrame, queries: DataFrame, k: int = 10, threshold: float = 0.7, recall: float = RECALL, seed: int = 3) -> DataFrame:
    """Approximate :func:`top_k_batch`: only pairs that share a signature of random planes are scored.

    A pair of cosine c meets with probability 1 - (1 - (1 - acos(c)/pi)**bits)**tables, and :func:`lsh_shape` derives
    both numbers from the threshold so that this is ``recall`` at the threshold and more above it.  The lower the threshold the
    more pairs meet (about 0.7 of all at 0.3, 0.05 at 0.7); at 0 or below planes rule out nothing and the exact search runs.
    Signatures are joined; one that holds very many vectors is split by adaptive execution.
    """
    if threshold <= 0:
        return top_k_batch(vectors, queries, k, threshold)
    tables, bits = lsh_shape(threshold, recall)
    size = vectors.select(F.max(F.size("embedding"))).first()[0] or 0
    planes = np.random.default_rng(seed).standard_normal((tables * bits, size))

    def signed(df: DataFrame, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = np.array(b.column("embedding").to_pylist(), dtype=np.float64).reshape(-1, size)
                up = (v @ planes.T > 0).reshape(len(v), tables, bits)
                sig = (up * (1 << np.arange(bits))).sum(axis=2) + (np.arange(tables) << 40)[None]
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("embedding"), pa.array(list(sig.astype(np.int64)), pa.list_(pa.int64()))], names=["key", "embedding", "sig"])

        rows = df.where(F.size("embedding") == size).select(F.col(name).cast("string").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))
        return rows.mapInArrow(run, "key string, embedding array<double>, sig array<long>")

    v, q = signed(vectors, "id"), signed(queries, "query_id")
    pairs = (
        q.select(F.col("key").alias("query_id"), F.explode("sig").alias("s")).join(v.select(F.col("key").alias("id"), F.explode("sig").alias("s")), "s").select("query_id", "id").distinct()
    )
    scored = (
        pairs.join(q.select(F.col("key").alias("query_id"), F.col("embedding").alias("a")), "query_id").join(v.select(F.col("key").alias("id"), F.col("embedding").alias("b")), "id")
        .select("query_id", "id", C.cosine(F.col("a"), F.col("b")).alias("raw")).where(F.col("raw") >= threshold).select("query_id", "id", F.round("raw", 6).alias("score"))
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


def full_text(memories: DataFrame, query: str, user_id: str | None = None, namespace: str | None = None, limit: int = 10) -> DataFrame:
    """Live memories that hold every word of ``query``; the score is the share of their words that are query words.

    A query without words finds nothing.
    """
    rows = active(memories)
    for column, value in (("user_id", user_id), ("namespace", namespace)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    words = C.words(F.lit(query))
    w = once(rows.select("id", "content", "metadata", "namespace", "importance")).select("*", C.words(F.col("content")).alias("w"), F.array_distinct(words).alias("q"))
    hit = w.where((F.size("q") > 0) & (F.size(F.array_except("q", "w")) == 0))
    score = F.size(F.filter("w", lambda x: F.array_contains("q", x))) / F.size("w")
    return hit.select("id", "content", "metadata", "namespace", "importance", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "id").limit(limit)


def embed_missing(texts: DataFrame, cache: DataFrame, now) -> DataFrame:
    """(content, key, embedding, hit): each distinct text's embedding, from the cache (key, embedding, expires_at) where it is fresh."""
    t = texts.select("content").where(F.col("content").isNotNull()).distinct().withColumn("key", F.concat(F.lit("embedding:"), C.sha256(F.col("content"))))
    fresh = cache.where(F.col("expires_at") > F.lit(now).cast("timestamp_ntz")).select("key", F.col("embedding").alias("cached"))
    j = t.join(fresh, "key", "left")
    return j.select("content", "key", F.coalesce("cached", C.embedding(F.col("content"))).alias("embedding"), F.col("cached").isNotNull().alias("hit"))
