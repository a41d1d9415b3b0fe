"""Deduplication and pairing as DataFrame plans."""
