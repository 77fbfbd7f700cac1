"""Registry of queries over the star-schema tables and their SQL."""

from __future__ import annotations

from tallyframe.plans import claim_queries, codec_queries, flow_queries, interval_queries, matching_queries, review_queries, sequence_queries, symbol_queries

PARTS = (claim_queries, interval_queries, matching_queries, review_queries, sequence_queries, codec_queries, flow_queries, symbol_queries)
FLAGSHIP = "claim_resolution"
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
