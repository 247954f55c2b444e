"""Structured Streaming forms of the work-log operators."""
