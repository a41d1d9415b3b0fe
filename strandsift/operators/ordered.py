"""The predecessor of every row in a global order, without a global window."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandsift.functions.sequences import hamming
from strandsift.operators.storage import materialised
from strandsift.shipping import ship


#: Bytes of sequences that are compared at once, besides the row that begins the stretch.
_STRETCH = 4 << 20


def _gaps(seqs: pa.BinaryArray, prev: pa.BinaryArray) -> pa.Array:
    """Bytes in which each sequence differs from the one in ``prev``; null for other lengths and nulls."""
    n = len(seqs)
    size, before = (pc.fill_null(pc.binary_length(x), -1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (seqs, prev))
    alike = (size == before) & (size >= 0)
    out = np.zeros(n, np.int32)
    rows = np.flatnonzero(alike)
    ends = np.cumsum(size[rows])
    start = 0
    while start < len(rows):
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + _STRETCH, "right")))
        take = pa.array(rows[start:stop])
        # rows of equal lengths on both sides: their bytes lie at the same places
        a, b = (np.frombuffer(b"".join(x.take(take).to_pylist()), np.uint8) for x in (seqs, prev))
        total = np.concatenate(([0], np.cumsum(a != b)))
        cuts = np.concatenate(([0], ends[start:stop] - base))
        out[rows[start:stop]] = np.diff(total[cuts])
        start = stop
    return pa.array(out, pa.int32(), mask=~alike)


def gaps_in_batches(it: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, list[pa.Array], list[pa.Array]]]:
    """Each batch that has rows with, by key, the sequences before and the distances to them; null for the first row of all."""
    last = [pa.nulls(1, pa.binary())] * len(keys)
    for b in it:
        n = b.num_rows
        if not n:
            continue
        cols = [b.column(b.schema.get_field_index(k)).cast(pa.binary()) for k in keys]
        prev = [pa.concat_arrays([end, col.slice(0, n - 1)]) for col, end in zip(cols, last)]
        yield b, prev, [_gaps(col, p) for col, p in zip(cols, prev)]
        last = [pa.array(c.slice(n - 1, 1).to_pylist(), pa.binary()) for c in cols]


def _walk(keys: list[str]):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, pos = TaskContext.get().partitionId(), 0
        for b, prev, gaps in gaps_in_batches(it, keys):
            n = b.num_rows
            out = list(b.columns)
            out += [pa.array(np.full(n, part, np.int64)), pa.array(np.arange(pos, pos + n, dtype=np.int64))]
            for p, gap in zip(prev, gaps):
                out += [p.cast(pa.string()), gap]
            names = b.schema.names + ["part", "pos"] + [f"{x}_{k}" for k in keys for x in ("prev", "gap")]
            yield pa.RecordBatch.from_arrays(out, names=names)
            pos += n

    return run


def with_previous(units: DataFrame, keys: list[str]) -> DataFrame:
    """units with part, pos, prev_<key> and gap_<key> (Hamming distance to it, null for other lengths and nulls), by ascending keys.

    Rows are dealt to ranges and sorted; inside a range the predecessor is
    the row before. The first row of a range gets the last row of the ranges
    before it from a table of one row a range.
    """
    ship(units.sparkSession)
    fields = units.schema.fields + [T.StructField("part", T.LongType()), T.StructField("pos", T.LongType())]
    for k in keys:
        fields += [T.StructField(f"prev_{k}", T.StringType()), T.StructField(f"gap_{k}", T.IntegerType())]
    walked = units.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_walk(keys), T.StructType(fields))
    walked = materialised(walked, "ordered")
    ends = walked.groupBy("part").agg(*[F.max_by(k, "pos").alias(f"end_{k}") for k in keys])
    by_part = Window.orderBy("part")
    ends = ends.select(F.col("part").alias("p"), *[F.lag(f"end_{k}").over(by_part).alias(f"end_{k}") for k in keys])
    # one row a partition of the sort
    rows = walked.join(F.broadcast(ends), F.col("part") == F.col("p"), "left")
    first = F.col("pos") == 0
    for k in keys:
        end = F.col(f"end_{k}")
        rows = rows.withColumn(f"gap_{k}", F.when(first, hamming(F.col(k), end)).otherwise(F.col(f"gap_{k}")))
        rows = rows.withColumn(f"prev_{k}", F.when(first, end).otherwise(F.col(f"prev_{k}")))
    return rows.drop("p", *[f"end_{k}" for k in keys])


def running_last(rows: DataFrame, value, name: str) -> DataFrame:
    """rows with the last non-null ``value`` at or before each, in (part, pos) order."""
    w = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__own", value)
    ends = rows.groupBy("part").agg(F.max_by("__own", F.when(F.col("__own").isNotNull(), F.col("pos"))).alias("end"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("part").alias("p"), F.last("end", ignorenulls=True).over(before).alias("end"))
    rows = rows.withColumn(name, F.last("__own", ignorenulls=True).over(w))
    rows = rows.join(F.broadcast(ends), F.col("part") == F.col("p"), "left")  # one row a partition
    return rows.withColumn(name, F.coalesce(name, "end")).drop("__own", "p", "end")
