"""Structured Streaming forms of the incremental checks."""
