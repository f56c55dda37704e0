"""Query catalog."""

from tallyforge.plans import aggregates, checks, curation, files, relations, streams, texts  # noqa: F401
from tallyforge.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
