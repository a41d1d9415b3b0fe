"""Deduplication of unbounded input."""
