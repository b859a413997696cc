"""Incremental (streaming) ingestion."""
