"""All queries of the retrieval engine and their SQL."""

from __future__ import annotations

from quillmere.plans import answer_queries, graph_queries, search_queries, text_queries  # noqa: F401
from quillmere.plans.registry import QUERIES, SQL  # noqa: F401
