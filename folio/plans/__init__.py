"""Compositions of operators into named queries."""

from __future__ import annotations

from folio.plans.registry import QUERIES, SQL, Query


def load() -> tuple[dict[str, Query], dict[str, str]]:
    """All queries and their SQL."""
    from folio.plans import catalog_conditions, catalog_corpus, catalog_eval, catalog_memory, catalog_text, catalog_vector  # noqa: F401

    return QUERIES, SQL
