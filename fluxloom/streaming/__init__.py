"""Structured Streaming forms of the period statistics."""
