"""Structured Streaming forms of the row-wise operators and of dedup."""
