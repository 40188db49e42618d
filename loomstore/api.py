"""The store's calls on snapshots of its tables: each reads, or returns a new store.

Missing or blank arguments raise ``ValueError``, unknown ids ``KeyError``; deletions of what isn't there say so instead.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstore import schema as S
from loomstore.functions import columns as C
from loomstore.functions.embed import embed
from loomstore.operators import dedup, graph, hashes, links, reads, search, writes
from loomstore.sources.tables import scratch

VERSION = "0.1.0"


def _need(**texts: str) -> None:
    for name, value in texts.items():
        if not value or not value.strip():
            raise ValueError(f"{name} must not be blank")


@dataclass(frozen=True)
class MemoryStore:
    """Tables of a store; ``vectors`` may be None, then searches read the text."""

    memories: DataFrame
    relations: DataFrame
    namespaces: DataFrame
    hashes: DataFrame
    vectors: DataFrame | None = None
    now: datetime | None = None

    @property
    def spark(self):
        return self.memories.sparkSession

    def _now(self) -> datetime:
        return self.now or datetime.now(timezone.utc).replace(tzinfo=None)

    def _row(self, memory_id: str) -> DataFrame:
        found = reads.get(self.memories, memory_id)
        if found.isEmpty():
            raise KeyError(memory_id)
        return found

    def _ids(self, *ids: str) -> DataFrame:
        return self.spark.createDataFrame([(i,) for i in ids], "id string")

    # reading

    def get(self, memory_id: str) -> DataFrame:
        return self._row(memory_id)

    def list(self, user_id: str | None = None, namespace: str | None = None, limit: int = 50, offset: int = 0) -> tuple[DataFrame, int]:
        """A page and the total, which an empty page reports as 0."""
        page = reads.listing_with_count(self.memories, user_id, namespace, limit, offset)
        first = page.select("total_count").head()
        return page.drop("total_count"), first[0] if first else 0

    def recent(self, namespace: str | None = None, limit: int = 20, since: datetime | None = None) -> DataFrame:
        return reads.recent(self.memories, namespace, since, limit)

    def search(self, query: str, user_id: str | None = None, limit: int = 10, threshold: float = 0.7, namespace: str | None = None) -> DataFrame:
        _need(query=query)
        if self.vectors is None:
            return search.full_text(self.memories, query, user_id, namespace, limit)
        vector = self.spark.range(1).select(C.embedding(F.lit(query)).alias("e")).first()["e"]
        if vector is None:
            return search.full_text(self.memories, query, user_id, namespace, 0)
        live = self.vectors.join(reads.active(self.memories).select("id").distinct(), "id", "left_semi")
        return search.hydrate(search.top_k(live, vector, limit, threshold, user_id, namespace), self.memories)

    find_similar = search

    def stats(self, user_id: str | None = None) -> DataFrame:
        return reads.stats(self.memories, user_id)

    def list_namespaces(self) -> DataFrame:
        return reads.namespaces(self.namespaces)

    def version(self) -> DataFrame:
        return self.spark.createDataFrame([("loomstore", VERSION)], "name string, version string")

    # writing

    def check(self, content: str, user_id: str, namespace: str = "default", metadata: str | None = None) -> DataFrame:
        _need(content=content, user_id=user_id)
        one = self.spark.createDataFrame([(0, user_id, content, metadata, namespace, None)], "ord long, user_id string, content string, metadata string, namespace string, importance int")
        return dedup.decisions(one, self.memories)

    def ingest(self, entries: DataFrame, apply_updates: bool = False) -> tuple["MemoryStore", DataFrame]:
        """(store with the batch taken in, results with ids): entries are (ord, user_id, content, metadata, namespace, importance).

        ``dedup.ingest_summary`` counts the results.
        """
        if entries.where(C.is_blank(F.col("content")) | C.is_blank(F.col("user_id"))).limit(1).count():
            raise ValueError("content and user_id must not be blank")
        out = dedup.ingest(entries, self.memories, self.relations, self.namespaces, self._now(), apply_updates)
        vectors = self.vectors
        if vectors is not None:
            new = out["memories"].join(self.memories.select("id"), "id", "left_anti")
            vectors = writes.upsert_vectors(vectors, scratch(embed(new.select("id", "user_id", "namespace", "content", "importance")).select(*vectors.columns), "points"))
        return replace(self, memories=out["memories"], relations=out["relations"], namespaces=out["namespaces"], vectors=vectors), out["results"]

    def store(self, content: str, user_id: str, metadata: str | None = None, namespace: str | None = None, importance: int | None = None) -> tuple["MemoryStore", DataFrame]:
        _need(content=content, user_id=user_id)
        one = self.spark.createDataFrame([(0, user_id, content, metadata, namespace, importance)], "ord long, user_id string, content string, metadata string, namespace string, importance int")
        new, results = self.ingest(one, apply_updates=True)
        return new, results.join(new.memories.select("id", "content", "metadata", "importance", "created_at", "updated_at"), "id").limit(1)

    def update(self, memory_id: str, content: str | None = None, metadata: str | None = None, importance: int | None = None) -> "MemoryStore":
        self._row(memory_id)
        change = self.spark.createDataFrame([(memory_id, content, metadata, importance)], "id string, content string, metadata string, importance int")
        memories = writes.update_memories(self.memories, change, self._now())
        relations, vectors = self.relations, self.vectors
        if metadata and '"links"' in metadata:
            relations = links.sync_batch(relations, memories, self._ids(memory_id), self._now()).drop("action")
        if content and vectors is not None:
            vectors = writes.update_vectors(vectors, change.select("id", C.embedding(F.col("content")).alias("embedding")))
        if importance is not None and vectors is not None:
            vectors = writes.set_payload(vectors, change.select("id", "importance"))
        return replace(self, memories=memories, relations=relations, vectors=vectors)

    def delete(self, memory_id: str) -> tuple["MemoryStore", bool]:
        found = not reads.get(self.memories, memory_id).isEmpty()
        memories, relations = writes.delete_memories(self.memories, self.relations, self._ids(memory_id))
        vectors = writes.delete_vectors(self.vectors, self._ids(memory_id)) if self.vectors is not None else None
        return replace(self, memories=memories, relations=relations, vectors=vectors), found

    def archive(self, memory_id: str) -> tuple["MemoryStore", bool]:
        self._row(memory_id)
        live = not reads.active(self.memories).where(F.col("id") == memory_id).isEmpty()
        vectors = writes.delete_vectors(self.vectors, self._ids(memory_id)) if self.vectors is not None else None
        return replace(self, memories=writes.archive(self.memories, self._ids(memory_id), self._now()), vectors=vectors), live

    def forget(self, user_id: str, namespace: str | None = None) -> tuple["MemoryStore", int]:
        _need(user_id=user_id)
        memories, n = writes.forget(self.memories, user_id, namespace, self._now())
        vectors = writes.delete_vectors_of(self.vectors, user_id, namespace) if self.vectors is not None else None
        return replace(self, memories=memories, vectors=vectors), n.first()[0]

    # graph

    def link(self, source: str, target: str, link_type: str = "related_to", description: str | None = None, weight: float = 1.0) -> tuple["MemoryStore", bool]:
        _need(source=source, target=target)
        if link_type not in S.LINK_TYPES:
            raise ValueError(f"no such link type: {link_type}")
        relations, made = links.link(self.relations, self.memories, source, target, link_type, description, weight, self._now())
        return replace(self, relations=relations), made

    def unlink(self, source_id: str, target_id: str, link_type: str) -> tuple["MemoryStore", bool]:
        found = not reads.relations_between(self.relations, source_id, target_id).where(F.col("link_type") == link_type).isEmpty()
        return replace(self, relations=links.delete_relation(self.relations, source_id, target_id, link_type)), found

    def get_relations(self, memory_id: str, link_type: str | None = None) -> DataFrame:
        return reads.relations_unified(self.relations, memory_id, link_type)

    def traverse(self, start_id: str, depth: int = 3, link_types: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges); the start must exist."""
        self._row(start_id)
        r = reads.clean_relations(self.relations)
        at = graph.reachable(r, start_id, depth, link_types)
        return graph.traverse_nodes(self.memories, r, start_id, depth, link_types, at), graph.traverse_edges(r, start_id, depth, link_types, at)

    def graph_stats(self) -> DataFrame:
        return graph.stats_json(self.memories, reads.clean_relations(self.relations))

    # resource hashes

    def hash_upsert(self, changes: DataFrame) -> tuple["MemoryStore", DataFrame]:
        """(store, refused): valid changes (source_type, source_id, content_hash, size_bytes, metadata, ord) taken in."""
        checked = hashes.problems(changes)
        new = hashes.upsert(self.hashes, checked.where(F.col("problem").isNull()).drop("problem"), self._now()).drop("action")
        return replace(self, hashes=new), checked.where(F.col("problem").isNotNull())

    def hash_get(self, source_type: str, source_id: str) -> DataFrame:
        return hashes.lookup(self.hashes, source_type, source_id)

    def hash_list(self, source_type: str | None = None, since: datetime | None = None, project_id: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
        return hashes.listing(self.hashes, source_type, since, project_id, limit, offset)

    def hash_delete(self, source_type: str, source_id: str) -> tuple["MemoryStore", bool]:
        found = not hashes.lookup(self.hashes, source_type, source_id).isEmpty()
        return replace(self, hashes=hashes.delete(self.hashes, source_type, source_id)), found
