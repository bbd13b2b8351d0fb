"""The registered queries over the driver's tables, and their SQL."""

from __future__ import annotations

from loomspan.plans import browser_queries, codon_queries, file_queries, frame_queries, graph_queries, interval_queries, output_queries, relation_queries

QUERIES = {**interval_queries.QUERIES, **relation_queries.QUERIES, **file_queries.QUERIES, **frame_queries.QUERIES, **output_queries.QUERIES, **codon_queries.QUERIES, **browser_queries.QUERIES, **graph_queries.QUERIES}
SQL = {**interval_queries.SQL, **relation_queries.SQL, **file_queries.SQL, **frame_queries.SQL, **output_queries.SQL, **codon_queries.SQL, **browser_queries.SQL, **graph_queries.SQL}
