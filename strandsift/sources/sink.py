"""Ordered single-file output, plain or gzip by the name's ending.

Every range of the order is written by its own task to a part in the shared
folder; the driver then joins the parts' bytes (gzip members may follow each
other), streaming: no row passes through it.
"""

from __future__ import annotations

import gzip
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame

from strandsift.operators.storage import shared_dir
from strandsift.shipping import ship
from strandsift.sources.reads import _open

_BUFFER = 4 << 20


def _parts(folder: str, packed: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _open(folder)
        ctx = TaskContext.get()
        path = f"{top}/{ctx.partitionId():08d}-{ctx.taskAttemptId()}"
        n = 0
        with fs.open_output_stream(path, compression=None) as raw:
            f = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=6, mtime=0) if packed else raw
            for b in it:
                rows = b.column(0).cast(pa.binary()).to_pylist()
                n += len(rows)
                if rows:
                    f.write(b"\n".join(rows) + b"\n")
            if packed:
                f.close()
        yield pa.RecordBatch.from_pydict({"part": pa.array([ctx.partitionId()], pa.int64()), "path": [path], "n": pa.array([n], pa.int64())})

    return run


def record_text(read: str, fmt: str) -> Column:
    """The lines of a record as they were read: read is a struct column's name."""
    from pyspark.sql import functions as F

    names = ("id", "seq", "sep", "qual") if fmt == "fastq" else ("id", "seq")
    return F.concat_ws("\n", *[F.col(f"{read}.{n}") for n in names])


def write_ordered(rows: DataFrame, text: Column, path: str, *order: str, packed: bool | None = None) -> int:
    """Writes ``text`` of each row, one a line, in ``order`` to the file ``path``; the number of rows."""
    folder = f"{shared_dir(rows.sparkSession)}/out-{uuid.uuid4().hex}"
    fs, top = _open(folder)
    fs.create_dir(top, recursive=True)
    ship(rows.sparkSession)
    packed = path.endswith(".gz") if packed is None else packed
    lines = rows.select(*order, text.alias("__line")).orderBy(*order).select("__line")
    parts = sorted(lines.mapInArrow(_parts(folder, packed), "part bigint, path string, n bigint").collect())  # a row a partition
    out_fs, out = _open(path)
    with out_fs.open_output_stream(out, compression=None) as f:
        for _, part, n in parts:
            if n:
                with fs.open_input_stream(part, compression=None) as g:
                    while block := g.read(_BUFFER):
                        f.write(block)
        if packed and not any(n for _, _, n in parts):
            f.write(gzip.compress(b"", mtime=0))
    fs.delete_dir(top)
    return sum(n for _, _, n in parts)
