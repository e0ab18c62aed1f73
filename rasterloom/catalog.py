"""All registered queries of the raster engine, with their checking SQL."""

from __future__ import annotations

from .plans import benchmark_queries, color_queries, label_queries, page_queries, picture_queries, region_queries

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
for _module in (color_queries, region_queries, benchmark_queries, page_queries, picture_queries, label_queries):
    QUERIES |= _module.QUERIES
    ORACLE |= _module.ORACLE
