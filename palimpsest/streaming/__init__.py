"""Structured Streaming: incremental ingest and per-key state."""
