"""Queries over the test tables: each runs an operator and carries SQL that says the same."""

from wiring.registry import ORACLES, QUERIES  # noqa: F401
from wiring import catalogue_queries, refresh_queries, page_queries, question_queries  # noqa: F401
from wiring import spec_queries, dialogue_queries, usage_queries, scalar_queries  # noqa: F401
