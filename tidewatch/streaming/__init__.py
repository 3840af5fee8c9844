"""Structured Streaming forms of the minute aggregation."""
