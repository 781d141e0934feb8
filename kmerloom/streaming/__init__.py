"""Structured Streaming forms of the mergeable aggregations."""
