"""Bringing the two mates together: by position or by read tag."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandsift.functions.tags import read_tag


def zipped(left: DataFrame, right: DataFrame) -> DataFrame:
    """(ord, r1, r2): the i-th left read with the i-th right one, up to the shorter side; ids are not compared.

    ord is dense in each file, so this is an equi-join.
    """
    a = left.select("ord", F.struct(*left.columns).alias("r1"))
    b = right.select("ord", F.struct(*right.columns).alias("r2"))
    return a.join(b, "ord")


def _numbered(reads: DataFrame, name: str) -> DataFrame:
    tagged = reads.withColumn("tag", read_tag(F.col("id")))
    n = F.row_number().over(Window.partitionBy("tag").orderBy("ord"))
    return tagged.select("tag", n.alias("n"), F.struct(*reads.columns).alias(name))


def matched(left: DataFrame, right: DataFrame) -> DataFrame:
    """(tag, n, r1, r2): the n-th read of each tag on the left with the n-th on the right."""
    return _numbered(left, "r1").join(_numbered(right, "r2"), ["tag", "n"])
