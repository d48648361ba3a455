"""Training-data operators: deduplication, sharding, scoring, archives, tokenisation.

Nothing else in the library imports this package; ``queries.QUERIES`` holds the
registered queries and ``oracle.SQL`` their DuckDB counterparts.
"""
