"""All queries of the library by name, with their SQL equivalents."""

from __future__ import annotations

from . import corpus_queries, deep_queries, entry_queries, feature_queries, file_queries, more_queries, tree_queries

FLAGSHIP = "a5_analysis_stats"
QUERIES = corpus_queries.QUERIES | tree_queries.QUERIES | more_queries.QUERIES | file_queries.QUERIES | feature_queries.QUERIES | deep_queries.QUERIES | entry_queries.QUERIES
ORACLES = corpus_queries.ORACLES | tree_queries.ORACLES | more_queries.ORACLES | file_queries.ORACLES | feature_queries.ORACLES | deep_queries.ORACLES | entry_queries.ORACLES
