"""Deduplication by options: every mode annotates all reads, results are projections of that.

ord identifies a read (pair) and must not repeat. A null sequence equals other
null ones and is near or a prefix of nothing else: reads that have it are
duplicates of the first of them (pairs: with equal mates).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandsift.operators import clusters as _clusters
from strandsift.operators.exact import distinct_units, first_of_each, tight_heads
from strandsift.operators.neighbor import hamming_heads
from strandsift.operators.pairing import matched, zipped
from strandsift.operators.prefix import loose_heads
from strandsift.operators.storage import forget, materialised

COMPARE = ("tight", "loose", "tail-hamming")


@dataclass(frozen=True)
class Options:
    """How to compare. fast excludes compare and distance; unordered needs fast and pairs; strict makes mates of unequal number an error."""

    compare: str = "tight"
    distance: int = 2
    fast: bool = False
    unordered: bool = False
    validate: bool = True
    strict: bool = False

    def __post_init__(self) -> None:
        if self.compare not in COMPARE:
            raise ValueError(f"unknown comparison: {self.compare}")
        if self.distance < 0:
            raise ValueError("distance must not be negative")
        if self.unordered and not self.fast:
            raise ValueError("unordered needs fast")


def heads(rows: DataFrame, options: Options) -> DataFrame:
    """The distinct sequences (pairs) of rows (ord, s1[, s2], ...) with their first ord and head_ord, the ord of their cluster's head."""
    units = distinct_units(rows)
    if options.compare == "tight":
        return tight_heads(units)
    units = materialised(units, "units")  # the plans below read them more than once
    if options.compare == "loose":
        return loose_heads(units)
    out = hamming_heads(units, options.distance)
    forget(units)
    return out


def annotated(rows: DataFrame, options: Options) -> DataFrame:
    """rows with head_ord and is_head."""
    keys = ["s1", "s2"] if "s2" in rows.columns else ["s1"]
    verdict = heads(rows, options).select(*[F.col(k).alias("__" + k) for k in keys], F.col("head_ord").cast("long"))
    same = [F.col(k).eqNullSafe(F.col("__" + k)) for k in keys]
    rows = rows.join(verdict, same).drop(*["__" + k for k in keys])
    return rows.withColumn("is_head", F.col("ord") == F.col("head_ord"))


@dataclass(frozen=True)
class Result:
    """kept: surviving reads or pairs with the columns to order them by; clusters and summary as in the schema."""

    rows: DataFrame
    options: Options
    mates: int
    left: DataFrame
    right: DataFrame | None = None

    @cached_property
    def annotated(self) -> DataFrame:
        return annotated(self.rows, self.options)

    @property
    def order(self) -> tuple[str, ...]:
        if self.options.unordered:
            return "tag", "n"
        if self.options.fast:
            return ("ord",)
        return ("s1", "s2")[: self.mates] + ("ord",)

    @cached_property
    def kept(self) -> DataFrame:
        o = self.options
        if o.unordered:
            return first_of_each(self.rows, "tag", "n", validate=o.validate)
        if o.fast:
            return first_of_each(self.rows, validate=o.validate)
        if o.compare == "tight":  # the same rows as the annotation's heads, with a limit before the shuffle
            return first_of_each(self.rows)
        # heads are found on sequences alone; whole records meet a list of numbers only
        return self.rows.join(heads(self.rows, o).where("ord = head_ord").select("ord"), "ord", "left_semi")

    @cached_property
    def clusters(self) -> DataFrame:
        if self.options.fast:
            raise ValueError("clusters are not available in fast mode")
        ids = [f"id{m}" for m in range(1, self.mates + 1)]
        rows = self.rows.select("ord", *[F.col(f"r{m}.id").alias(i) for m, i in enumerate(ids, 1)], *("s1", "s2")[: self.mates])
        if self.mates == 2:  # the mates meet once: units and annotation read the pairs
            rows = materialised(rows, "pairs")
        table = materialised(annotated(rows, self.options).select("ord", "head_ord", *ids), "annotated")  # heads and members
        forget(rows)
        return _clusters.membership(table, self.mates)

    @cached_property
    def summary(self) -> DataFrame:
        """total and duplicates of reads or pairs; unmatched counts reads without partner (pairs only)."""
        total, kept = F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("ord") == F.col("head_ord"))
        out = heads(self.rows, self.options).agg(total.alias("total"), (total - kept).alias("duplicates"))
        if self.right is None:
            return out.withColumn("unmatched", F.lit(None).cast("long"))
        n = sum(side.count() for side in (self.left, self.right))
        return out.select("total", "duplicates", (F.lit(n) - 2 * F.col("total")).alias("unmatched"))


def dedup(left: DataFrame, right: DataFrame | None = None, options: Options | None = None) -> Result:
    """Deduplicates reads (ord, id, seq, ...) or, with ``right``, pairs of them."""
    o = options or Options()
    if right is None:
        if o.unordered:
            raise ValueError("unordered needs two inputs")
        rows = left.select("ord", F.struct(*left.columns).alias("r1"), F.col("seq").alias("s1"))
        return Result(rows, o, 1, left)
    if o.strict and left.count() != right.count():
        raise ValueError("the two inputs differ in their number of reads")
    pairs = matched(left, right) if o.unordered else zipped(left, right)
    rows = pairs.withColumn("s1", F.col("r1.seq")).withColumn("s2", F.col("r2.seq"))
    if o.unordered:
        rows = rows.withColumn("ord", F.col("r1.ord"))
    return Result(rows, o, 2, left, right)
