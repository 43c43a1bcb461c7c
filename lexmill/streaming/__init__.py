"""Incremental versions of batch operators (Structured Streaming)."""
