"""Readers, writers and shared-folder tables."""

from loomstore.sources.tables import read_table, scratch, drop_scratch

__all__ = ["read_table", "scratch", "drop_scratch"]
