"""Structured Streaming: incremental ingest and event-time windows."""
