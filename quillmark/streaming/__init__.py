"""Transforms that run alike on tables and on streams."""
