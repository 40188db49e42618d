"""Schemas and fixed values of the memory store."""

from __future__ import annotations

# Tables as DDL.
MEMORIES = (
    "id string, user_id string, content string, metadata string, namespace string, namespace_id string, content_hash string, source_type string, "
    "source_location string, version int, is_archived boolean, importance int, created_at timestamp_ntz, updated_at timestamp_ntz"
)
RELATIONS = (
    "id string, source_id string, target_id string, target_name string, link_type string, description string, weight double, metadata string, created_at timestamp_ntz"
)
NAMESPACES = (
    "id string, uid string, name string, description string, created_at timestamp_ntz, updated_at timestamp_ntz"
)
HASHES = (
    "id string, source_type string, source_id string, content_hash string, size_bytes long, metadata string, created_at timestamp_ntz, updated_at timestamp_ntz"
)

# The link types that a relation may have.
LINK_TYPES = (
    "depends_on", "used_by", "extends", "implements", "contains", "contained_by", "calls", "called_by", "related_to", "contradicts", "solves", "tested_by", "implements_adr", "references",
    "follows", "precedes", "alternative_to", "causes", "prevents", "runs_on", "exposes", "mounts", "derived_from", "motivates", "informs", "informed_by", "connected_to",
)
# Similarity from which a new entry counts as known, per namespace; any other namespace takes the last.
THRESHOLDS = {"default": 0.95, "user_facts": 0.90, "dialogue_insights": 0.85, "code_knowledge": 0.95, "project_meta": 0.90, "infrastructure": 0.95}
THRESHOLD = 0.95
# Namespaces that every store starts with.
NAMESPACE_SEEDS = ("default", "user_facts", "code_knowledge", "dialogue_insights", "project_meta", "infrastructure")
# Kinds of hashed resources, and states of a migrated record.
SOURCE_TYPES = ("session", "file", "project")
LEDGER_STATES = ("pending", "migrated", "failed", "skipped")

#: Columns that reads of single memories return.
MEMORY_COLUMNS = ("id", "user_id", "content", "metadata", "namespace", "importance", "created_at", "updated_at", "content_hash")
#: Mark of relations that were made from a memory's metadata.
SYNCED = '{"synced_from": "metadata.links"}'
