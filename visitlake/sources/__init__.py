"""Scans (table loaders, test-data derivations) and sinks."""

from visitlake.sources.documents import document_columns, documents, load_sampled, malformed, merged_type, sampled_fields, sampled_schema
from visitlake.sources.sinks import json_records, preview, write_json, write_parquet
from visitlake.sources.tables import Tables, load_tables, normalise

__all__ = [
    "Tables", "load_tables", "normalise", "json_records", "preview", "write_json", "write_parquet",
    "document_columns", "documents", "load_sampled", "malformed", "merged_type", "sampled_fields", "sampled_schema",
]
