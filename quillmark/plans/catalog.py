"""Registers all queries."""

from . import aggregates, curation, documents, events, gates, landed, pages, relations, search, sources, tabs, updates, vectors  # noqa: F401
