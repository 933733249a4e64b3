"""Incremental forms of the corpus jobs (Structured Streaming)."""
