"""Deduplication of sequencing reads as Spark plans."""
