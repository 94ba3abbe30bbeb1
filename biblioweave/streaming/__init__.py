"""Incremental updates with Structured Streaming."""
