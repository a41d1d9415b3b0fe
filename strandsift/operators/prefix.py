"""Loose mode: a read that extends the one before it in sorted order is its duplicate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandsift.operators.exact import keys_of
from strandsift.operators.ordered import running_last, with_previous

#: Prefix windows serve while the shared prefix has this many bases and no prefix more distinct reads.
LEAST_PREFIX, MOST_ROWS = 8, 1_000_000


def loose_heads(units: DataFrame, strategy: str | None = None) -> DataFrame:
    """units with head_ord: the first ord of the cluster's shortest read.

    The reference for a read is always its direct predecessor among the
    distinct sequences (pairs), so one look back decides. All members of a
    chain share the first k bases, k being the least length: windows over
    that prefix never part two neighbours that could be linked. Where k is
    short or one prefix is hot, ranges with stitched ends do the same.
    """
    keys = keys_of(units)
    least = units.agg(F.min(F.length("s1")).alias("k")).first()["k"] or 0
    if strategy is None:
        strategy = "range"
        if least >= LEAST_PREFIX:
            # by hash: prefixes that collide count together, which can only choose ranges sooner
            hot = units.groupBy(F.xxhash64(F.substring("s1", 1, least))).count().agg(F.max("count").alias("n")).first()["n"]
            strategy = "prefix" if hot <= MOST_ROWS else "range"
    if strategy == "range":
        rows = with_previous(units, keys)
        dup = _extends(keys, [F.col(f"prev_{k}") for k in keys])
        return running_last(rows, F.when(~dup, F.col("ord")), "head_ord").select(*units.columns, "head_ord")
    # a column of its own, so that both windows share one exchange
    w = Window.partitionBy("__prefix").orderBy(*keys)
    dup = _extends(keys, [F.lag(k).over(w) for k in keys])
    rows = units.withColumn("__prefix", F.substring("s1", 1, least)).withColumn("__head", F.when(~dup, F.col("ord")))
    return rows.withColumn("head_ord", F.last("__head", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__head", "__prefix")


def _extends(keys, prev):
    out = F.lit(True)
    for k, p in zip(keys, prev):
        out = out & F.startswith(F.col(k), p)
    return F.coalesce(out, F.lit(False))
