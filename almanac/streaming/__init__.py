"""Structured Streaming ingest of newly arriving bulletin files."""
