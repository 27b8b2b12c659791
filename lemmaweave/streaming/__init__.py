"""Structured Streaming ingest and state folds."""
