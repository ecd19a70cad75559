"""All queries: importing this module fills the registry."""

from __future__ import annotations

from ledgerlark.plans import answer_queries, document_queries, more_queries, points_queries, retrieval_queries, state_queries  # noqa: F401
from ledgerlark.plans.registry import QUERIES

FLAGSHIP = QUERIES["retrieve"]
