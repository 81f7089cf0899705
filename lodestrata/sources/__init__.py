"""Typed readers and sinks."""

from lodestrata.sources.tables import load_table, table_path

__all__ = ["load_table", "table_path"]
