"""Tail-hamming mode: greedy clusters of sorted neighbours within a Hamming distance.

A read joins the current cluster if it is as long as the cluster's head and
within the distance of it; otherwise it is the next head. Where the distance
to the predecessor exceeds twice the limit, or the length changes, a new
cluster begins whatever came before (triangle inequality). From the first of
these sure breaks on, a range of the order is folded where it was sorted. The
rows before it, which may belong to a cluster of the range before, are folded
after that range's last head.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsift.operators.exact import keys_of
from strandsift.operators.ordered import gaps_in_batches
from strandsift.operators.storage import materialised
from strandsift.shipping import ship


def _columns(b: pa.RecordBatch, keys: list[str]) -> list[list[bytes | None]]:
    return [b.column(b.schema.get_field_index(k)).cast(pa.binary()).to_pylist() for k in keys]


def _array(row) -> list[np.ndarray | None]:
    return [None if x is None else np.frombuffer(x, np.uint8) for x in row]


def _near(head, row, distance: int) -> bool:
    return all(a is not None and b is not None and len(a) == len(b) and np.count_nonzero(a != b) <= distance for a, b in zip(head, row))


def _fold_ranges(keys: list[str], distance: int):
    """Adds part, pos and head_ord, which stays null before the range's first sure break."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        head, head_ord = None, None
        for b, _, gaps in gaps_in_batches(it, keys):
            n = b.num_rows
            sure = np.zeros(n, bool)
            for gap in gaps:
                sure |= gap.fill_null(2 * distance + 1).to_numpy(zero_copy_only=False) > 2 * distance
            if not pos:
                sure[0] = False  # its predecessor is in another range
            heads = []
            for o, cut, *row in zip(b.column(b.schema.get_field_index("ord")).to_pylist(), sure.tolist(), *_columns(b, keys)):
                if cut or head is not None:
                    row = _array(row)
                    if cut or not _near(head, row, distance):
                        head, head_ord = row, o
                heads.append(head_ord)
            out = [*b.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(pos, pos + n, dtype=np.int64)), pa.array(heads, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=[*b.schema.names, "part", "pos", "head_ord"])
            pos += n

    return run


def _fold_chains(keys: list[str], distance: int):
    """Fills in head_ord. A row that has one already is the head of what follows in its chain."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, head, head_ord = None, None, None
        for b in it:
            get = lambda name: b.column(b.schema.get_field_index(name)).to_pylist()  # noqa: E731,B023
            heads = []
            for c, o, known, *row in zip(get("chain"), get("ord"), get("head_ord"), *_columns(b, keys)):
                row = _array(row)
                if known is not None or c != chain or not _near(head, row, distance):
                    chain, head, head_ord = c, row, o
                heads.append(head_ord)
            i = b.schema.get_field_index("head_ord")
            yield b.set_column(i, b.schema.field(i), pa.array(heads, pa.int64()))

    return run


def hamming_heads(units: DataFrame, distance: int = 2) -> DataFrame:
    """units with head_ord, the first ord of the cluster's head."""
    ship(units.sparkSession)
    keys = keys_of(units)
    schema = T.StructType([*units.schema.fields, *[T.StructField(c, T.LongType()) for c in ("part", "pos", "head_ord")]])
    rows = units.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_fold_ranges(keys, distance), schema)
    rows = materialised(rows, "folded")
    is_head = F.col("ord") == F.col("head_ord")
    # one row a range: the place of its last head, if it has one, and the last range before it that has one
    ranges = rows.groupBy("part").agg(F.max(F.when(is_head, F.col("pos"))).alias("last"))
    before = F.last(F.when(F.col("last").isNotNull(), F.col("part")), ignorenulls=True).over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranges = F.broadcast(ranges.select(F.col("part").alias("p"), "last", before.alias("before")))
    rows_of = rows.join(ranges, F.col("part") == F.col("p"))
    opened = rows_of.where("head_ord is null").select(*rows.columns, F.coalesce("before", F.lit(-1)).alias("chain"))
    ends = rows_of.where(is_head & (F.col("pos") == F.col("last"))).select(*rows.columns, F.col("part").alias("chain"))
    chains = opened.withColumn("end", F.lit(False)).union(ends.withColumn("end", F.lit(True)))
    chains = chains.repartition("chain").sortWithinPartitions("chain", "part", "pos")
    chains = chains.mapInArrow(_fold_chains(keys, distance), chains.schema).where("not end")
    out = [*units.columns, "head_ord"]
    return rows.where("head_ord is not null").select(*out).union(chains.select(*out))
