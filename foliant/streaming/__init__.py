"""Structured Streaming versions: ingest, states, search index, answers, memo, metrics."""
