"""Structured Streaming forms of the batch rules."""
