"""Predicates and measures on sequences, as Spark columns: no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bases that the fast modes accept.
ALPHABET = "ACGTN"


def is_valid(seq: Column) -> Column:
    return seq.rlike(f"^[{ALPHABET}]*\\z")


def checked(seq: Column) -> Column:
    """``seq`` itself; the query fails at the first one with another letter.

    It is the key that later steps need, so the check cannot be pruned away.
    """
    return F.when(is_valid(seq), seq).otherwise(F.raise_error(F.concat(F.lit("Unknown base in sequence: "), seq)).cast("string"))


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ; null for sequences of different length."""
    marks = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int"))
    return F.when(F.length(a) == F.length(b), F.when(a == b, F.lit(0)).otherwise(F.aggregate(marks, F.lit(0), lambda s, v: s + v)))


def same(a: Column, b: Column) -> Column:
    """Tight comparison."""
    return a == b


def prefix_compatible(a: Column, b: Column) -> Column:
    """Loose comparison: equal over the shorter of the two."""
    return F.startswith(a, b) | F.startswith(b, a)


def prefix_compatible_pair(a1: Column, a2: Column, b1: Column, b2: Column) -> Column:
    """Loose comparison of pairs: both mates are compatible and the longer one of each is on the same side."""
    longer = (F.length(b1) <= F.length(a1)) & (F.length(b2) <= F.length(a2))
    shorter = (F.length(b1) > F.length(a1)) & (F.length(b2) > F.length(a2))
    return prefix_compatible(a1, b1) & prefix_compatible(a2, b2) & (longer | shorter)


def within(a: Column, b: Column, distance: int) -> Column:
    """Equal length and at most ``distance`` differences."""
    return F.coalesce(hamming(a, b) <= distance, F.lit(False))
