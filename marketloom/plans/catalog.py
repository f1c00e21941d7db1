"""All queries outside the training-data subpackage, by name, with their SQL."""

from __future__ import annotations

from . import advice, cycle, ingest, market, records, resolve, similarity, small, streams, texts  # noqa: F401
from .registry import QUERIES, SQL

FLAGSHIP = "demand_stats"
__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
