"""Every query of the engine by name, with its SQL."""

from . import graph_queries, log_queries, registry, text_queries, upkeep_queries, vector_queries  # noqa: F401  (importing registers the queries)

QUERIES = registry.QUERIES
ORACLE_SQL = registry.ORACLE_SQL
