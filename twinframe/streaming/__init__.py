"""Incremental scans driven by Structured Streaming."""
