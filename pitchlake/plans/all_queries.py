"""All registered queries of the library proper."""

from pitchlake.plans import club_queries, core_queries, data_queries, document_queries, page_queries, registry, score_queries, serving_queries

MODULES = (core_queries, score_queries, club_queries, data_queries, serving_queries, page_queries, document_queries)
queries = lambda: dict(registry.QUERIES)
oracles = registry.oracles
