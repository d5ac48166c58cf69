"""Composed queries: trend numbers, enriched views and the query entry points."""
