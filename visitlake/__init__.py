"""visitlake — visitor, order and campaign analytics as Spark DataFrame operators.

Every public operator takes DataFrames (plus explicit parameters) and returns a
DataFrame. Building some runs bounded probe jobs, which fetch row sizes and key hashes only. See README.md for the operator list.
"""

from visitlake.sources.tables import Tables, load_tables

__all__ = ["Tables", "load_tables"]
