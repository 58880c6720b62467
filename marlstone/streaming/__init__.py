"""Structured Streaming forms of ingestion and global aggregation."""
