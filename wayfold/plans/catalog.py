"""The query catalogue: one query per operator, with its SQL."""

from __future__ import annotations

from wayfold.plans import image_queries, io_queries, kernel_queries, pose_queries, space_queries, table_queries

MODULES = (pose_queries, space_queries, image_queries, table_queries, io_queries, kernel_queries)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
for module in MODULES:
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL
