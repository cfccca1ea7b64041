"""Incremental scoring on Structured Streaming."""
