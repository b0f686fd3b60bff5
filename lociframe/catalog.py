"""All registered queries of the library and their SQL."""

from __future__ import annotations

from lociframe.plans import gene_queries, layout_queries, read_queries, source_queries  # noqa: F401
from lociframe.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
