"""Structured Streaming forms of the ordered stages."""
