"""Queries over the test tables; importing ``load`` registers them all."""

from __future__ import annotations


def load() -> None:
    """Registers every query of the library."""
    from lumenfold.plans import catalog_queries, event_queries, media_queries, metric_queries, stored_queries, text_queries, word_queries  # noqa: F401
