"""The registered queries and the SQL that states the same results."""

from __future__ import annotations

from parchmint.plans import fold_queries, html_queries, stream_queries  # noqa: F401  they register their queries
from parchmint.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
