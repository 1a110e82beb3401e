"""Structured Streaming forms of the daily work."""
