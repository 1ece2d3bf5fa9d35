"""Ingest as a stream: Structured Streaming micro-batches into a store."""
