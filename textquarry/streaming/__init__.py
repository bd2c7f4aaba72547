"""Incremental index maintenance with Structured Streaming."""
