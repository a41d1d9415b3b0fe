"""Distinct reads of a stream.

A bounded input has a first read of every sequence; a stream has the first to
arrive. With a watermark, a sequence is remembered for that long only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.functions.sequences import checked


def distinct_stream(reads: DataFrame, seq_cols: tuple[str, ...] = ("seq",), time_col: str | None = None, delay: str = "10 minutes", validate: bool = True) -> DataFrame:
    """The first read of each sequence (pair) of a streaming DataFrame, once, in the order of arrival."""
    if validate:
        for c in seq_cols:
            reads = reads.withColumn(c, checked(F.col(c)))
    if time_col is None:
        return reads.dropDuplicates(list(seq_cols))
    return reads.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(list(seq_cols))
