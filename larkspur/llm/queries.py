"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from larkspur.llm import centroids, hnsw, huffman, licenses, maxent, mixing, mixpack, neardup, packing, rules, sharding, weaklabels, whitening

MODULES = (sharding, rules, huffman, mixing, hnsw, licenses, neardup, maxent, weaklabels, packing, centroids, mixpack, whitening)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE = {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
