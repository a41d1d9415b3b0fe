"""Exact duplicates: fast and tight modes.

``reads`` has ord, s1 and, for pairs, s2 besides whatever is carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandsift.functions.sequences import checked


def keys_of(reads: DataFrame) -> list[str]:
    return ["s1", "s2"] if "s2" in reads.columns else ["s1"]


def first_of_each(reads: DataFrame, *order: str, validate: bool = False) -> DataFrame:
    """The first row of each sequence (pair) in ``order`` (ord by default).

    The rank limit is applied before the shuffle too, so that a task sends
    one row a key at most, however hot the key.
    """
    keys = keys_of(reads)
    cols = [checked(F.col(k)) if validate else F.col(k) for k in keys]
    rank = F.row_number().over(Window.partitionBy(*cols).orderBy(*(order or ("ord",))))
    return reads.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def distinct_units(reads: DataFrame) -> DataFrame:
    """(s1[, s2], ord, n): each distinct sequence (pair), its first ord and its count, combined before the shuffle."""
    return reads.groupBy(*keys_of(reads)).agg(F.min("ord").alias("ord"), F.count(F.lit(1)).alias("n"))


def tight_heads(units: DataFrame) -> DataFrame:
    """units with head_ord: every distinct sequence is a cluster of its own."""
    return units.withColumn("head_ord", F.col("ord"))
